"""Scalar functions as Columns of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_case(c: Column) -> Column:
    """Case fold: upper then lower, with both sharp s as ss, which the built-in mappings leave as one letter."""
    return F.lower(F.upper(F.regexp_replace(c, "[\u00df\u1e9e]", "ss")))


def bucket_label(c: Column, bounds: list[float]) -> Column:
    """Label of the half-open bucket of a number: <b0, [bi,bj), >=bn. Bounds: 1 to 64, ascending, finite."""
    if not 1 <= len(bounds) <= 64 or any(b != b or abs(b) == float("inf") for b in bounds) or any(a >= b for a, b in zip(bounds, bounds[1:], strict=False)):
        raise ValueError("bounds must be 1 to 64 finite numbers in ascending order")
    show = lambda x: f"{x:g}"
    out = F.when(c < bounds[0], F.lit(f"<{show(bounds[0])}"))
    for a, b in zip(bounds, bounds[1:], strict=False):
        out = out.when(c < b, F.lit(f"[{show(a)},{show(b)})"))
    return out.when(c.isNotNull(), F.lit(f">={show(bounds[-1])}"))


UNITS = ("second", "minute", "hour", "day", "week", "month", "year")


def time_bucket(ts: Column, unit: str, count: int = 1, zone: str = "UTC") -> Column:
    """Start of the bucket of `count` units that holds an instant, counted from 1970 (weeks from a Monday) in a zone."""
    if unit not in UNITS or count < 1:
        raise ValueError(f"a bucket is a positive count of {UNITS}")
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    if unit in ("month", "year"):
        months = F.year(local) * 12 + F.month(local) - 1 - 1970 * 12
        step = count * (12 if unit == "year" else 1)
        first = F.floor(months / step) * step + 1970 * 12
        start = F.make_date(F.floor(first / 12).cast("int"), (first % 12 + 1).cast("int"), F.lit(1)).cast("timestamp")
    else:
        seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit] * count
        shift = 345600 if unit == "week" else 0  # 1970-01-05 was a Monday
        start = F.timestamp_seconds(F.floor((F.unix_timestamp(local) - shift) / seconds) * seconds + shift)
    return F.to_utc_timestamp(start, zone)


def parse_timestamp(c: Column) -> Column:
    """An instant from RFC 3339 text, a date, or epoch seconds; null for anything else."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.timestamp_seconds(c.try_cast("double")))


def zone_offset_minutes(c: Column) -> Column:
    """Minutes of an offset +HH:MM or -HH:MM; null otherwise."""
    p = r"^([+-])(\d{2}):(\d{2})$"
    minutes = F.regexp_extract(c, p, 2).try_cast("int") * 60 + F.regexp_extract(c, p, 3).try_cast("int")
    return F.when(c.rlike(p), F.when(F.regexp_extract(c, p, 1) == "-", -minutes).otherwise(minutes))


def directory_chain(path: Column, root: bool = False) -> Column:
    """All directories above a path, shortest first, with "." first if root."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(".")), above) if root else above


def top_directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def last_segment(name: Column) -> Column:
    """Last run of letters, digits and _ of a qualified name."""
    return F.regexp_extract(name, r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1)


#: Words that carry no meaning in claims. Fixed values, which must be these for equal results.
STOP_WORDS = tuple(
    """the and for with that this from must should shall will have has are was when user users system all any not into onto
    each per its his her their been being than then they them there here where which while before after every all any the
    a an of to in on is be""".split()
)


def tokens(c: Column) -> Column:
    """Lower-case words of three letters or more of camelCase, snake_case and plain text, plural s cut, stop words out."""
    parted = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    words = F.filter(F.split(F.lower(F.trim(parted)), " "), lambda w: F.length(w) >= 3)
    stemmed = F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_except(F.array_distinct(stemmed), F.array(*map(F.lit, STOP_WORDS)))


def humanise(name: Column) -> Column:
    """snake_case and camelCase as capitalised words."""
    return F.initcap(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.#]+", " "))


def line_of(text: Column, offset: Column) -> Column:
    """Line, from 1, of a character offset from 0."""
    head = F.substr(text, F.lit(1), offset)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of parts, each told from its neighbours and null from empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts)), 256)


def type_rank(c: Column, kind: str) -> Column:
    """Rank of a mixed sort: null, then numbers, then text, then the rest."""
    return F.when(c.isNull(), 0).otherwise({"number": 1, "string": 2}.get(kind, 3))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def test_gap(n: Column) -> Column:
    """1 without tests, then falling with the logarithm of their number."""
    return F.when(n == 0, F.lit(1.0)).otherwise(1 / F.greatest(F.lit(1.0), F.log(1 + n)))


def path_params(path: Column) -> Column:
    """Names of {id} and :id parameters of a route, in order."""
    return F.regexp_extract_all(path, F.lit(r"(?:\{|:)([A-Za-z_]+)\}?"), F.lit(1))


#: Patterns of secrets (fixed values).
SECRETS = {
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "github_token": r"ghp_[A-Za-z0-9]{36}",
    "payment_key": r"sk_live_[A-Za-z0-9]{16,}",
    "assignment": r"(?i)(?:password|passwd|secret|api_key|token)\s*[:=]\s*['\"]?[^\s'\"]{6,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
#: Marks of values that are no secrets (fixed values).
PLACEHOLDERS = r"(?i)xxx|changeme|example|placeholder"


def secret_kind(c: Column) -> Column:
    """The first kind of secret found in a text, null for none or a placeholder."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECRETS.items()):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(~c.rlike(PLACEHOLDERS), out)


def classify_claim(c: Column) -> Column:
    """Modality of a sentence by the first keyword class it has: prohibition, obligation, recommendation, permission, statement."""
    low = F.lower(c)
    return (
        F.when(low.rlike(r"\b(must not|shall not|never|may not)\b"), "prohibition")
        .when(low.rlike(r"\b(must|shall|required)\b"), "obligation")
        .when(low.rlike(r"\b(should|recommended)\b"), "recommendation")
        .when(low.rlike(r"\b(may|can|optional)\b"), "permission")
        .otherwise("statement")
    )
