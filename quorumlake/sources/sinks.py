"""Writers: JSON lines, star tables, feeds and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines by year of the meeting."""
    records.withColumn("year", F.substring("date", 1, 4)).write.mode("overwrite").partitionBy("year").json(path)


def write_lines(rows: DataFrame, path: str, column: str = "line") -> None:
    rows.select(column).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Semicolons, all cells quoted; arrays joined by ', ', '-' where empty."""
    flat = [F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("-").alias(c) if kind.startswith("array<string") else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("sep", ";").option("quoteAll", True).option("header", True).csv(path)


def star_tables(records: DataFrame) -> dict[str, DataFrame]:
    """meetings, business_numbers, amounts, locations and votes of records (record_id, date, numbers, amounts, places, votes)."""

    def values(column: str) -> DataFrame:
        return records.select("record_id", F.posexplode(column).alias("pos", "value"))

    return {
        "meetings": records.groupBy("date").agg(F.count("*").alias("n")),
        "business_numbers": values("numbers"),
        "amounts": values("amounts"),
        "locations": values("places"),
        "votes": records.select("record_id", F.posexplode("votes").alias("pos", "v")).select("record_id", "pos", "v.subject", "v.outcome", F.array_join("v.approval", ", ").alias("approval"), F.array_join("v.against", ", ").alias("against")),
    }


def write_star(records: DataFrame, folder: str) -> None:
    """Each table written anew as Parquet."""
    for name, table in star_tables(records).items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def json_line(*columns: Column | str) -> Column:
    """A JSON object of columns, as one line."""
    return F.to_json(F.struct(*columns))


def summary_pairs(counts: DataFrame) -> DataFrame:
    """(key, value) of counts (metric, key, n)."""
    return counts.select(F.when(F.col("key") == "", F.col("metric")).otherwise(F.concat_ws(":", "metric", "key")).alias("key"), F.col("n").cast("string").alias("value"))


def catalogue(sources: DataFrame, loaded: DataFrame) -> DataFrame:
    """sources (source, license) with how many rows of each are loaded."""
    counts = loaded.groupBy("source").agg(F.count("*").alias("n"))
    return sources.join(counts, "source", "left").select("source", "license", F.coalesce("n", F.lit(0)).alias("n"))
