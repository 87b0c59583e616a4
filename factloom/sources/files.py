"""Files of a tree as rows: walk, language, manifests, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages by extension and by the interpreter of a first line (fixed values).
EXTENSIONS = {"py": "python", "rs": "rust", "go": "go", "java": "java", "js": "javascript", "ts": "typescript", "sh": "shell", "sql": "sql", "c": "c", "cpp": "cpp", "md": "markdown"}
INTERPRETERS = {"python": "python", "sh": "shell", "bash": "shell", "node": "javascript"}
TOO_LARGE, HEAD = 16 << 20, 8 << 10


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, skipped, content) of all files below root; binary and too large ones are kept with a reason and no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    binary = F.contains(F.substring("content", 1, HEAD), F.lit(b"\x00"))
    why = F.when(F.col("length") > TOO_LARGE, "too large").when(binary, "binary")
    return files.select("path", F.col("length").alias("size"), why.alias("skipped"), F.when(why.isNull(), F.decode("content", "UTF-8")).alias("content"))


def detect_language(rows: DataFrame, path: str = "path", head: str = "head") -> DataFrame:
    """rows with language: by extension, then by the interpreter after #!; null if neither is known."""
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    interpreter = F.regexp_extract(head, r"^#!\s*\S*?/?(?:env\s+)?([a-z]+)[0-9.]*\s*(?:\n|$)", 1)
    return rows.withColumn("language", F.coalesce(F.try_element_at(table(EXTENSIONS), extension), F.try_element_at(table(INTERPRETERS), interpreter)))


def parse_manifests(rows: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, kind, name, version) of dependency lines: name==version in text files, name = "version" in TOML."""
    lines = rows.select(path, F.explode(F.split(text, "\n")).alias("line"))
    pattern = F.when(F.col(path).endswith(".toml"), F.lit(r'^([A-Za-z0-9_-]+)\s*=\s*"([^"]+)"')).otherwise(F.lit(r"^([A-Za-z0-9_.-]+)==([^\s#]+)"))
    out = lines.select(F.col(path).alias("path"), F.lit("package").alias("kind"), "line", pattern.alias("p"))
    found = out.select("path", "kind", F.expr("regexp_extract(line, p, 1)").alias("name"), F.expr("regexp_extract(line, p, 2)").alias("version"))
    return found.filter("name <> ''")


def diagnostics(rows: DataFrame, key: str, limit: int, first=None, secret: tuple[str, ...] = (), most: int = 2000) -> DataFrame:
    """A page of a table by its key, secret columns redacted and text cut to `most` characters."""
    kept = rows if first is None else rows.filter(F.col(key) >= F.lit(first))
    shown = [F.lit("redacted").alias(f.name) if f.name in secret else F.substring(f.name, 1, most).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in rows.schema]
    return kept.orderBy(key).limit(limit).select(*shown)


#: Entities of markup and what they stand for (fixed values); the ampersand last, so none is decoded twice.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_text(c: Column) -> Column:
    """The prose of a page: no bodies of scripts and styles, no tags, entities decoded, one space for white space."""
    for pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", "<[^>]*>"):
        c = F.regexp_replace(c, pattern, " ")
    for name, plain in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(plain))
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
