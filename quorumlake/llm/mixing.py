"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 48-bit hash. A source whose target is k whole copies of
itself plus a rest takes every document k times and, once more, those whose
hash lies below a threshold. The threshold is found from token sums by source
and hash bucket: twelve bits locate the bucket in which the budget runs out,
and only that bucket's documents are summed again by their next twelve bits,
until all 48 bits are used. Nothing is sorted, and a larger budget always keeps
what a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, materialise

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
LEVEL_BITS, LEVELS = 12, 4
_ALL = 1 << (LEVEL_BITS * LEVELS)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(id_column, text_column):
    """48 bits of id and text, alike in every run and engine."""
    text = F.md5(F.coalesce(text_column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(":"), text)), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, target) from one row per source.

    Weights 1, 2, 3 go round by code point, null last. A target stops at three
    times its source; sources in the order of cap to weight are full until the
    rest's even share fits under the next one's cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    shared = (
        sizes.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
        .withColumn("cap", MOST_COPIES * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("place", F.row_number().over(by_room))
        .withColumn("left", F.col("total") - (F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")))
        .withColumn("weights", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("share", F.col("left") / F.col("weights"))
        .withColumn("free", F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.col("place")))
        .withColumn("first_free", F.min("free").over(Window.partitionBy()))
        .withColumn("level", F.max(F.when(F.col("place") == F.col("first_free"), F.col("share"))).over(Window.partitionBy()))
    )
    target = F.when(F.col("place") < F.col("first_free"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return shared.select("source", "sid", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(sid, edge, edge_rows): hashes under edge are taken, and so many of the rows at it, which are alike."""
    state = budgets.select("sid", F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    found = None
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        key = F.shiftright("h", shift)
        inside = rows.join(state, "sid")
        if level:
            inside = inside.where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("sid", key.alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("left").alias("left"))
        upto = F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        over = sums.withColumn("before", upto - F.col("n")).where(F.col("before") + F.col("n") > F.col("left"))
        edge = over.groupBy("sid").agg(F.min_by(F.struct("bucket", "before", "left", "n", "rows"), "bucket").alias("e"))
        state = materialise(edge.select("sid", (F.col("e.left") - F.col("e.before")).alias("left"), F.col("e.bucket").alias("prefix"), F.col("e.n").alias("n"), F.col("e.rows").alias("rows")), f"op3-level{level}")
        found = state
        state = state.drop("n", "rows")
    taken = F.least(F.floor(F.col("left") * F.col("rows") / F.col("n") + 0.5), F.col("rows")).cast("long")
    return found.select("sid", F.col("prefix").alias("edge"), taken.alias("taken"), "rows")


def _chosen(slim: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, edge, edge_in): one row per source."""
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = materialise(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "op3-plan")
    rows = slim.join(plan.select("source", "sid"), slim["source"].eqNullSafe(plan["source"])).select("sid", "size", "h")
    edges = _thresholds(rows, plan.select("sid", "rest"))
    partly = (F.col("taken") > 0) & (F.col("taken") < F.col("rows"))
    full = plan.join(edges, "sid", "left").select(
        *("source", "source_size", "target", "whole"),
        F.coalesce("edge", F.lit(_ALL)).alias("edge"),
        F.coalesce(F.col("taken") == F.col("rows"), F.lit(False)).alias("edge_in"),
        F.when(partly, F.col("taken")).alias("some"),
    )
    return materialise(full, "op3-thresholds")


def _copies(h, whole, edge, edge_in):
    return F.least(whole + F.when((h < edge) | ((h == edge) & edge_in), 1).otherwise(0), F.lit(MOST_COPIES)).cast("int")


def _with_copies(rows: DataFrame, chosen: DataFrame, source: Column, h: Column, copies: str) -> DataFrame:
    """rows joined with their source's thresholds (chosen's columns) and how often each is taken.

    Rows of one id and text are alike at a threshold. Where a source takes some
    of these only, they are counted off: within the parts in which they lie,
    each part from where those before it end.
    """
    name, _, _, whole, edge, edge_in, some = chosen.columns
    joined = rows.join(chosen, source.eqNullSafe(F.col(name)))
    taken = _copies(h, F.col(whole), F.col(edge), F.col(edge_in))
    if chosen.where(F.col(some).isNotNull()).isEmpty():
        return joined.withColumn(copies, taken)
    at_edge = F.col(some).isNotNull() & (h == F.col(edge))
    part, n, before = (free_name(x, joined) for x in ("part", "n", "before"))
    alike = materialise(joined.where(at_edge).withColumn(part, F.spark_partition_id()), "op3-alike")
    sizes = alike.groupBy(name, part).agg(F.count("*").alias(n))
    starts = sizes.withColumn(before, F.sum(n).over(Window.partitionBy(name).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)).drop(n)
    starts = starts.select(F.col(name).alias(f"{name}_"), F.col(part).alias(f"{part}_"), before)
    place = F.row_number().over(Window.partitionBy(name, part).orderBy(h)) + F.col(before)
    counted = alike.join(starts, F.col(name).eqNullSafe(F.col(f"{name}_")) & (F.col(part) == F.col(f"{part}_")))
    counted = counted.withColumn(copies, F.least(F.col(whole) + F.when(place <= F.col(some), 1).otherwise(0), F.lit(MOST_COPIES)).cast("int"))
    return joined.where(~at_edge).withColumn(copies, taken).unionByName(counted.select(*joined.columns, copies))


def _slim(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    name = F.col(source_col).cast("string").alias("source")
    size = word_count(F.col(text_col).cast("string")).alias("size")
    return materialise(documents.select(F.col(id_col).alias("id"), name, size, document_hash(F.col(id_col), F.col(text_col)).alias("h")), "op3-sizes")


def mix_sources(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken), one row per input row.

    A null text has size 0, a null source is a source of its own, an empty table
    gives no rows. Rows with the same id, or none, are told apart by their texts,
    and of rows with the same id and text as many are taken as the target asks for. Columns other
    than the three named play no part.
    """
    slim = _slim(documents, id_col, text_col, source_col)
    chosen = _chosen(slim)
    chosen = chosen.select(F.col("source").alias("name"), *chosen.columns[1:])
    mixed = _with_copies(slim, chosen, F.col("source"), F.col("h"), "copies")
    return mixed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it.

    Copies follow from a document's own hash and its source's threshold: only
    the short table of thresholds is joined, never the texts to their sizes.
    """
    chosen = _chosen(_slim(documents, id_col, text_col, source_col))
    chosen = chosen.select(*[F.col(c).alias(free_name(f"mix_{c}", documents)) for c in chosen.columns])
    copies = free_name("copies", documents)
    h = document_hash(F.col(id_col), F.col(text_col))
    mixed = _with_copies(documents, chosen, F.col(source_col).cast("string"), h, copies)
    return mixed.withColumn(free_name("copy", documents), F.explode(F.array_repeat(F.lit(0), copies))).select(*[F.col(f"`{c}`") for c in documents.columns])
