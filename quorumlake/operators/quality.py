"""Validation, audit and exports of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import labels, text
from quorumlake.functions.extract import OUTCOME_LABELS

STATUSES = tuple(OUTCOME_LABELS)


def errors(required: tuple[str, ...]) -> Column:
    """All errors of a row: missing fields, unknown type or status, confidence out of range, incomplete votes."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"Pflichtfeld fehlt: {c}")) for c in required]
    rules = [
        F.when(~F.coalesce(F.col("kind").isin(*labels.TYPES), F.lit(False)), F.concat(F.lit("record_type ungültig: "), text.text(F.col("kind")))),
        F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.concat(F.lit("status ungültig: "), text.text(F.col("status")))),
        F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), F.lit("parser_confidence muss zwischen 0 und 1 liegen")),
    ]
    return F.array_compact(F.array(*missing, *rules))


def vote_errors(votes: Column) -> Column:
    """Errors of votes without subject or outcome, by their place."""
    sides = F.transform(
        votes,
        lambda v, i: F.array_compact(F.array(*[F.when(text.text(v[c]) == "", F.concat(F.lit("votes["), i.cast("string"), F.lit(f"].{c} fehlt"))) for c in ("subject", "outcome")])),
    )
    return F.flatten(sides)


def split_valid(records: DataFrame, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejected ones with their errors)."""
    checked = records.withColumn("errors", errors(required))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


LOW_SCORE = 0.44


def audit(records: DataFrame) -> DataFrame:
    """(part, key, n): counts by source and status, fallbacks by date, missing and low-scored matches."""
    by_source = records.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("unbekannt")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("source").alias("part"), "key", "n")
    by_status = records.groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("status").alias("part"), "key", "n")
    fallback = records.where("source = 'protokoll'").groupBy(F.col("date").alias("key")).agg(F.count("*").alias("n")).select(F.lit("fallback").alias("part"), "key", "n")
    low = records.where((F.col("source") == "portal") & (F.coalesce("score", F.lit(0.0)) < LOW_SCORE)).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("low_score").alias("part"), F.col("kind").alias("key"), "n")
    return by_source.unionByName(by_status).unionByName(fallback).unionByName(low)


def xml_escaped(value: Column) -> Column:
    out = text.text(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rss_item(title: Column, link: Column, date: Column, body: Column) -> Column:
    parts = [F.concat(F.lit(f"<{tag}>"), xml_escaped(v), F.lit(f"</{tag}>")) for tag, v in (("title", title), ("link", link), ("pubDate", date), ("description", body))]
    return F.concat(F.lit("<item>"), *parts, F.lit("</item>"))


def ics_escaped(value: Column) -> Column:
    out = F.replace(text.text(value), F.lit("\\"), F.lit("\\\\"))
    for a, b in ((";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ics_event(uid: Column, start: Column, title: Column) -> Column:
    """One VEVENT as lines joined by CR LF."""
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), ics_escaped(uid)), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.replace(start, F.lit("-"), F.lit(""))), F.concat(F.lit("SUMMARY:"), ics_escaped(title)), F.lit("END:VEVENT")]
    return F.concat_ws("\r\n", *lines)


def csv_line(*values: Column) -> Column:
    """Quoted, semicolon-separated cells."""
    return F.concat_ws(";", *[F.concat(F.lit('"'), F.replace(text.text(v), F.lit('"'), F.lit('""')), F.lit('"')) for v in values])


def markdown(counts: DataFrame) -> DataFrame:
    """Report lines '- key: n' in order, from (part, key, n)."""
    return counts.select("part", F.concat(F.lit("- "), "key", F.lit(": "), F.col("n").cast("string")).alias("line"))
