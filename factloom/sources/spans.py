"""Trace spans from OTLP JSON or a flat JSON array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string>>"


def parse_spans(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(trace, span, parent, name, start_ns, end_ns, status) of payloads of either form."""
    nested = F.from_json(payload, f"struct<resourceSpans:array<struct<scopeSpans:array<struct<spans:array<{SPAN}>>>>>>")
    flat = F.from_json(payload, f"array<{SPAN}>")
    inside = F.flatten(F.flatten(F.transform(nested["resourceSpans"], lambda r: F.transform(r["scopeSpans"], lambda s: s["spans"]))))
    is_array = F.ltrim(F.col(payload)).startswith("[")
    spans = rows.select(F.explode(F.when(is_array, flat).otherwise(inside)).alias("s"))
    return spans.select(F.col("s.traceId").alias("trace"), F.col("s.spanId").alias("span"), F.col("s.parentSpanId").alias("parent"), "s.name", F.col("s.startTimeUnixNano").cast("long").alias("start_ns"), F.col("s.endTimeUnixNano").cast("long").alias("end_ns"), F.col("s.status.code").alias("status"))
