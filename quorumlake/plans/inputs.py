"""Civic records derived from the bundled tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.functions import extract, labels
from quorumlake.storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_PLACE = "replace(p_name, ' ', '')"

#: One record per order: customers are people, parts name places and projects.
RAW = f"""
SELECT o_orderkey AS id, 'r' || CAST(o_orderkey AS STRING) AS record_id, {_DAY} AS date, substr({_DAY}, 1, 4) AS year,
  CASE o_orderkey % 8 WHEN 0 THEN 'agenda_item' WHEN 1 THEN 'urgent_motion' WHEN 2 THEN 'written_question' WHEN 3 THEN 'written_motion'
    WHEN 4 THEN 'communication' WHEN 5 THEN 'question_hour' WHEN 6 THEN 'amendment_motion' ELSE 'archive_source' END AS kind,
  CASE o_orderkey % 5 WHEN 0 THEN 'Tagesordnung' WHEN 1 THEN 'Dringlichkeitsanträge' WHEN 2 THEN 'Fragestunde' WHEN 3 THEN 'Mitteilungen' ELSE '' END AS section,
  CAST(o_orderkey % 30 AS INT) AS item_no,
  CASE o_custkey % 4 WHEN 0 THEN 'portal' WHEN 1 THEN 'protokoll' WHEN 2 THEN 'portal' ELSE '' END AS source,
  CAST(o_custkey % 100 AS DOUBLE) / 100 AS score,
  'protokoll_' || {_DAY} || '.docx' AS source_file,
  CASE o_orderkey % 6 WHEN 0 THEN 'Sanierung der ' || {_PLACE} || 'straße' WHEN 1 THEN 'Förderung Kindergarten ' || p_name
    WHEN 2 THEN 'Radweg ' || {_PLACE} || 'gasse und ' || {_PLACE} || 'platz' WHEN 3 THEN 'Bebauungsplan ' || p_name || ' KG Waltendorf EZ ' || CAST(o_custkey AS STRING)
    WHEN 4 THEN 'Müllabfuhr und Lärm im Bereich ' || {_PLACE} || 'weg' ELSE 'Jahresabschluss der ' || p_type || ' Holding GmbH' END AS subject,
  'A ' || CAST(o_custkey % 30 + 1 AS STRING) || ' - ' || CAST(100000 + o_custkey AS STRING) || '/' || substr({_DAY}, 1, 4) || '/' || CAST(o_orderkey % 7 + 1 AS STRING) AS number_text,
  'GR ' || replace(c_name, '#', ' ') AS person,
  '€ ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ',-' AS amount_text,
  CASE o_orderstatus WHEN 'F' THEN 'Der Antrag wurde mehrheitlich angenommen (Gegen: Grüne, Neos und KPÖ).'
    WHEN 'O' THEN 'Der geschäftsordnungsmäßigen Behandlung zugewiesen.'
    ELSE CASE o_custkey % 3 WHEN 0 THEN 'Der Zusatzantrag wurde abgelehnt (Zustimmung: SPÖ).' WHEN 1 THEN 'Wurde zur Kenntnis genommen.' ELSE 'Der Tagesordnungspunkt wurde einstimmig angenommen.' END END AS result_text,
  'https://records.example.org/' || replace(lower(p_brand), '#', '') || '/doc?x=1&ref=' || CAST(o_orderkey AS STRING) || '#top' AS url,
  'von ' || CAST(EXTRACT(DAY FROM o_orderdate) AS STRING) || '.' || CAST(EXTRACT(MONTH FROM o_orderdate) AS STRING) || '. bis ' || CAST(EXTRACT(DAY FROM o_orderdate) AS STRING) || '.' ||
    CAST(EXTRACT(MONTH FROM o_orderdate) AS STRING) || '.' || CAST(EXTRACT(YEAR FROM o_orderdate) + o_orderkey % 3 AS STRING) AS period_text,
  c_mktsegment AS segment, o_totalprice AS price, o_custkey AS custkey
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{part}} ON p_partkey = o_custkey
"""

#: The heading of each record's agenda item.
HEADING = "'Stk. ' || CAST(item_no AS STRING) || ') ' || number_text || ' ' || subject || ' (Berichterstatterin: ' || person || ')'"
#: Its text: what it is about, what is applied for, the result, and a remark with another amount.
BODY = (
    "'Bisher kostete es € 500,-.' || chr(10) || 'Der Gemeinderat wolle beschließen: ' || subject || ' im Ausmaß von ' || amount_text || '.' || chr(10) || result_text "
    "|| chr(10) || 'Im Vorjahr waren es € 99,-.'"
)


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records, dealt out by the key of both joins."""
    return spark.sql(RAW, orders=spread(table(spark, sf_dir, "orders"), "o_custkey"), customer=table(spark, sf_dir, "customer"), part=table(spark, sf_dir, "part"))


def raw_sql() -> str:
    """RAW as a DuckDB subquery with heading and body."""
    return f"(SELECT *, {HEADING} AS heading, {BODY} AS body FROM ({RAW.format(orders='orders', customer='customer', part='part')}))"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with extracted fields."""
    rows = raw_records(spark, sf_dir).selectExpr("*", f"{HEADING} AS heading", f"{BODY} AS body")
    found = extract.status_of(F.col("body"))
    return rows.withColumns(
        {
            "title": extract.title_of(F.regexp_replace("heading", r"^Stk\. [0-9]+\) ", "")),
            "status": found["status"],
            "status_text": found["status_text"],
            "numbers": extract.business_numbers(F.col("heading")),
            "amounts": extract.amounts_of_item(F.col("heading"), F.col("body")),
            "places": F.filter(F.array_distinct(extract.all_of(F.col("subject"), extract.STREET)), lambda p: ~F.lower(p).isin(*extract.NOT_PLACES)),
            "submitter": extract.submitter_of(F.col("heading")),
            "category": labels.category(F.col("subject")),
        }
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, line_no, line): each meeting day's minutes, section headings first and then four lines per item."""
    return spark.sql(LINES.format(raw="{raw}"), raw=raw_records(spark, sf_dir).selectExpr("*", f"{HEADING} AS heading", f"{BODY} AS body"))


LINES = """
SELECT date AS source, CAST(id * 10 AS BIGINT) AS line_no, section AS line FROM {raw} WHERE section <> ''
UNION ALL SELECT date, CAST(id * 10 + 1 AS BIGINT), 'Berichterstatterin: ' || person FROM {raw} WHERE id % 3 = 0
UNION ALL SELECT date, CAST(id * 10 + 2 AS BIGINT), heading FROM {raw}
UNION ALL SELECT date, CAST(id * 10 + 3 AS BIGINT), CAST(item_no + 1 AS STRING) || '. ' || subject FROM {raw} WHERE id % 2 = 0
UNION ALL SELECT date, CAST(id * 10 + 4 AS BIGINT), 'Betreff: ' || subject FROM {raw}
UNION ALL SELECT date, CAST(id * 10 + 5 AS BIGINT), result_text FROM {raw}
UNION ALL SELECT date, CAST(id * 10 + 6 AS BIGINT), 'Gegen: Grüne' FROM {raw} WHERE id % 2 = 1
"""


def lines_sql() -> str:
    return "(" + LINES.format(raw=raw_sql()) + ")"
