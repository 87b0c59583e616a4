"""Ranking, sequence and paging operators."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_LIMIT, TOKEN_SECONDS = 500, 900


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark limits groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def within_last(events: DataFrame, by: str, order: list[str], item: str, k: int) -> DataFrame:
    """events with `before`: the items of the k events before each in its sequence."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-k, -1)
    return events.withColumn("before", F.collect_list(item).over(w))


def seen_before(events: DataFrame, by: str, order: list[str], flag: Column) -> Column:
    """Whether flag held for an earlier event of the sequence."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0)) == 1


class BadToken(ValueError):
    """A continuation that was changed, belongs to another query, or is too old."""


def _sign(secret: bytes, body: bytes) -> str:
    return hmac.new(secret, body, hashlib.sha256).hexdigest()


def page_token(secret: bytes, query: str, after: list, now: float | None = None) -> str:
    body = json.dumps({"q": hashlib.sha256(query.encode()).hexdigest(), "after": after, "t": int(now if now is not None else time.time())}).encode()
    return base64.urlsafe_b64encode(body).decode() + "." + _sign(secret, body)


def read_token(secret: bytes, query: str, token: str, now: float | None = None) -> list:
    try:
        raw, sign = token.split(".")
        body = base64.urlsafe_b64decode(raw)
    except ValueError as e:
        raise BadToken("no token") from e
    if not hmac.compare_digest(sign, _sign(secret, body)):
        raise BadToken("the token was changed")
    data = json.loads(body)
    if data["q"] != hashlib.sha256(query.encode()).hexdigest():
        raise BadToken("the token is of another query")
    if (now if now is not None else time.time()) - data["t"] > TOKEN_SECONDS:
        raise BadToken("the token is too old")
    return data["after"]


def page(rows: DataFrame, keys: list[str], limit: int, after: list | None = None) -> DataFrame:
    """The next `limit` rows by ascending keys after a row's keys: a keyset, so no earlier page is read again."""
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"a page has 1 to {PAGE_LIMIT} rows")
    if after is not None:
        past: Column = F.lit(False)
        same: Column = F.lit(True)
        for k, v in zip(keys, after, strict=True):
            past = past | (same & (F.col(k) > F.lit(v)))
            same = same & (F.col(k) == F.lit(v))
        rows = rows.filter(past)
    return rows.orderBy(*keys).limit(limit)
