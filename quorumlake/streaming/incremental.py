"""Incremental updates of the records table by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quorumlake.operators.link import first_per_key
from quorumlake.operators.quality import split_valid


def new_dates(seen: DataFrame, known: DataFrame, column: str = "date") -> DataFrame:
    """Dates of seen that known lacks."""
    return seen.select(column).distinct().join(known.select(column).distinct(), column, "left_anti")


def cache_covers(requested: DataFrame, cached: DataFrame, version: int, column: str = "date") -> bool:
    """Whether the snapshot has this version and all requested dates."""
    return new_dates(requested, cached.where(F.col("cache_version") == version), column).isEmpty()


def additions(base: DataFrame, batch: DataFrame, required: tuple[str, ...], known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the batch to be added to base, rejected rows with their errors).

    Rows of dates that known (base, if not given) lacks are validated first. Of the
    valid ones all without an id are added, and of each id that base lacks one:
    the first by date and the digest of all its columns.
    """
    fresh = batch.join(new_dates(batch, base if known is None else known), "date", "left_semi")
    valid, rejected = split_valid(fresh, required)
    blank = F.coalesce(F.col("record_id"), F.lit("")) == ""
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in valid.columns])), 256)
    one = first_per_key(valid.where(~blank), ["record_id"], F.col("date"), digest)
    new = one.join(base.select("record_id").distinct(), "record_id", "left_anti")
    return valid.where(blank).select(*base.columns).unionByName(new.select(*base.columns)), rejected


def merged(base: DataFrame, batch: DataFrame, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(records after the batch, rejected rows): base rows stay whole, additions() come to them."""
    added, rejected = additions(base, batch, required)
    return base.unionByName(added), rejected


def unfinished(records: DataFrame, summaries: DataFrame, most: int) -> DataFrame:
    """The first rows, by id, that have no summary yet."""
    return records.join(summaries.where("summary <> ''").select("record_id"), "record_id", "left_anti").orderBy("record_id").limit(most)


class Versions:
    """Parts of a table in one folder, a part for each batch; the table after a batch is all parts up to it.

    A part is there once it is whole. Writing it again replaces it, so that a
    batch that is played again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def numbers(self) -> list[int]:
        """The parts that are there."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return sorted(int(n[5:]) for n in names if n.startswith("part=") and files.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS")))

    def write(self, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/part={number}")

    def parts(self, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/part={n}" for n in numbers])

    def until(self, number: int) -> DataFrame:
        """The table before the batch of this number."""
        return self.parts([n for n in self.numbers() if n < number])

    def all(self) -> DataFrame:
        return self.parts(self.numbers())

    def last(self) -> DataFrame:
        """The newest part alone, for tables that each batch makes anew."""
        return self.parts(self.numbers()[-1:])


@dataclass(frozen=True)
class View:
    """A table made of the records and of other views, by their names."""

    name: str
    make: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()


LOG_SCHEMA = "batch long, view string, outcome string, message string"


def refreshed(records: DataFrame, views: list[View], folder: str, number: int) -> list[tuple[int, str, str, str]]:
    """Make the views anew, those first that others need, and write each as part number of its folder; returns log rows.

    A view that fails, when it is planned or when it runs, is logged with its
    error. What needs it is skipped; both keep the parts they have. All others go on.
    """
    spark = records.sparkSession
    by_name = {v.name: v for v in views}
    log, made = [], {"records": records}
    for name in TopologicalSorter({v.name: v.needs for v in views}).static_order():
        if name == "records":
            continue
        view = by_name[name]
        missing = [n for n in view.needs if n not in made and n != "records"]
        if missing:
            log.append((number, name, "skipped", f"needs {', '.join(missing)}"))
            continue
        try:
            rows = view.make(made)
            store = Versions(spark, f"{folder}/{name}", rows.schema)
            store.write(number, rows)
            made[name] = store.parts([number])
            log.append((number, name, "made", ""))
        except (PySparkException, Py4JJavaError) as error:
            log.append((number, name, "failed", str(error).splitlines()[0]))
    return log


def update_step(table: Versions, batch: DataFrame, number: int, required: tuple[str, ...], rejects: str, views: list[View] = (), folder: str = "") -> None:
    """Add a batch to the table as its part number, write its rejected rows beside it, and make the views anew.

    Part -1 is what was there before the stream: its dates are known, and later
    files of a date that came with the stream still add to it.
    """
    spark = batch.sparkSession
    added, rejected = additions(table.until(number), batch, required, table.parts([-1]))
    table.write(number, added)
    rejected.write.mode("overwrite").parquet(f"{rejects}/part={number}")
    if views:
        log = refreshed(table.until(number + 1), list(views), folder, number)
        spark.createDataFrame(log, LOG_SCHEMA).write.mode("overwrite").parquet(f"{folder}/log/part={number}")


def run_updates(
    spark: SparkSession,
    source: str,
    schema: str,
    table: Versions,
    checkpoint: str,
    required: tuple[str, ...],
    rejects: str,
    views: list[View] = (),
    folder: str = "",
    files: int = 1000,
    every: str | None = None,
) -> StreamingQuery:
    """Add JSON files that arrive in source to the table, so many files a batch.

    Started again with the same checkpoint it goes on where it stopped; a batch
    that had not been committed is played again from the parts before it. Without
    an interval what is there is taken, in batches, and the stream ends.
    """

    def step(batch: DataFrame, number: int) -> None:
        update_step(table, batch, number, required, rejects, views, folder)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type of a stream or table of events (ts, event_type, value)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
