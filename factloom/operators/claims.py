"""Claims of documents: extraction and the ladder of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalar import classify_claim

# Words that make a line a claim, the least and most of its length, the least confidence of a mapping.
MODALITY = ("must", "shall", "should", "may", "will", "never", "always")
LEAST_BYTES, MOST_CHARACTERS, LEAST_CONFIDENCE = 12, 500, 0.34
ENDS = r"^[ \t\r]+|[ \t\r]+$"


def extract_claims(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, line_no (from 1), section, claim, modality of each line that is a bullet or has a word of modality.

    Bullets start with -, * or a digit with a full stop after; their marks don't
    count. A claim has more than LEAST_BYTES bytes and is cut at
    MOST_CHARACTERS. section is the last heading (#) up to the line, empty
    before the first. A document stays one row until its claims are known: nothing is shuffled.
    """
    trimmed = F.transform(F.split(text_col, "\n"), lambda x: F.regexp_replace(x, ENDS, ""))
    headings = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("at"), F.when(x.startswith("#"), F.regexp_replace(F.regexp_replace(x, "^#+", ""), ENDS, "")).alias("section"))), lambda h: h["section"].isNotNull())
    rows = docs.select(id_col, trimmed.alias("_lines")).withColumn("_heads", headings)
    line = F.col("_line")
    bullet = line.rlike("^[-*]") | (line.rlike("^[0-9]") & (F.octet_length(line) > 2) & line.contains("."))
    body = F.regexp_replace(line, r"^[-*> ]+", "")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "^[0-9]+", ""), r"^(\. )+", ""), ENDS, "")
    each = rows.select(id_col, "_heads", F.posexplode("_lines").alias("_at", "_line")).withColumn("_body", body)
    found = each.filter((bullet | F.lower("_body").rlike("|".join(MODALITY))) & (F.octet_length("_body") > LEAST_BYTES))
    section = F.try_element_at(F.filter("_heads", lambda h: h["at"] <= F.col("_at")), F.lit(-1))["section"]
    claim = F.substring("_body", 1, MOST_CHARACTERS)
    return found.select(id_col, (F.col("_at") + 1).cast("long").alias("line_no"), F.coalesce(section, F.lit("")).alias("section"), claim.alias("claim"), classify_claim(F.col("_body")).alias("modality"))


def claim_status(**facts: Column) -> Column:
    """The verdict on a claim, from the first rung of the ladder that applies.

    facts: claimed, superseded, timed_out, measurable (a claim of speed or
    size), vague, confidence (of its best mapping, null for none), broken
    (findings against it), prohibition, was_implemented, signal (behaviour of
    the mapped code). What isn't claimed is undocumented; a verdict never
    comes from time that ran out or from a mapping below LEAST_CONFIDENCE.
    """
    f = {k: F.coalesce(v, F.lit(False)) if k != "confidence" else v for k, v in facts.items()}
    out = F.when(~f["claimed"], "undocumented").when(f["superseded"], "superseded").when(f["timed_out"], "unknown")
    out = out.when(f["measurable"] | f["vague"], "unverifiable").when(f["confidence"].isNull(), "missing").when(f["confidence"] < LEAST_CONFIDENCE, "unverifiable")
    out = out.when(f["broken"], "contradicting").when(f["prohibition"] | f["signal"], "implemented")
    return out.when(f["was_implemented"], "drifted").otherwise("partial")
