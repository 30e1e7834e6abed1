"""Filters, counts, facets and ordered tables over records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import labels, text


@dataclass(frozen=True)
class Filters:
    """What a reader has chosen; None means all."""

    date: str | None = None
    year: str | None = None
    kind: str | None = None
    status: str | None = None
    category: str | None = None
    source: str | None = None
    with_amounts: bool | None = None
    query: str | None = None


def haystack(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def filtered(records: DataFrame, chosen: Filters, searched: tuple[str, ...], topic_ids: DataFrame | None = None) -> DataFrame:
    """Records that meet every choice; topic_ids (record_id) is a semi-join."""
    kept = records
    for column, value in (("date", chosen.date), ("kind", chosen.kind), ("status", chosen.status), ("category", chosen.category), ("source", chosen.source)):
        if value is not None:
            kept = kept.where(F.col(column) == value)
    if chosen.year is not None:
        kept = kept.where(F.startswith("date", F.lit(chosen.year)))
    if chosen.with_amounts is not None:
        kept = kept.where((F.size("amounts") > 0) == chosen.with_amounts)
    if chosen.query:
        kept = kept.where(F.contains(text.fold(haystack(*searched)), text.fold(F.lit(chosen.query))))
    return kept if topic_ids is None else kept.join(topic_ids, "record_id", "left_semi")


def facet(records: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column, most frequent first."""
    return records.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def top_labels(records: DataFrame, groups: list[str], column: str, most: int) -> DataFrame:
    """(groups, labels): the most frequent values of column in each group as 'x (n)', ties by name."""
    counts = records.groupBy(*groups, column).agg(F.count("*").alias("n"))
    placed = counts.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("n").desc(), column))).where(F.col("place") <= most)
    shown = F.array_sort(F.collect_list(F.struct("place", F.concat(F.col(column), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("label"))))
    return placed.groupBy(*groups).agg(F.array_join(F.transform(shown, lambda x: x["label"]), ", ").alias("labels"))


def summary(records: DataFrame) -> DataFrame:
    """(metric, key, n): totals and counts by file, section, status and type, in one pass."""
    named = records.select("source_file", F.when(F.col("section") == "", "unknown").otherwise(F.col("section")).alias("section"), "status", "kind")
    sets = named.groupingSets([[F.col("source_file")], [F.col("section")], [F.col("status")], [F.col("kind")], []], "source_file", "section", "status", "kind")
    counted = sets.agg(F.count("*").alias("n"), F.grouping_id("source_file", "section", "status", "kind").alias("g"))
    metric = F.create_map(F.lit(7), F.lit("file"), F.lit(11), F.lit("section"), F.lit(13), F.lit("status"), F.lit(14), F.lit("type"), F.lit(15), F.lit("total"))
    return counted.select(metric[F.col("g").cast("int")].alias("metric"), F.coalesce("source_file", "section", "status", "kind", F.lit("")).alias("key"), "n")


def record_table(records: DataFrame, most: int = 350) -> DataFrame:
    """The first rows by date (newest first), type, number and title, numbered."""
    rank = labels.rank_of_type(F.col("kind"), F.col("section"))
    order = [F.col("date").desc(), F.col("type_rank"), F.col("item_no"), F.lower("title"), F.col("record_id")]
    top = records.withColumn("type_rank", rank).orderBy(*order).limit(most)
    return top.withColumn("row", F.row_number().over(Window.orderBy(*order)))


def suggestions(values: DataFrame, query: str, most: int = 7) -> DataFrame:
    """(value, score): values that fit a typed query, best first, short ones before long ones."""
    q = text.fold(F.lit(query))
    v = text.fold(F.col("value"))
    tokens = F.filter(F.split(q, " +"), lambda t: F.length(t) >= 2)
    per_token = F.aggregate(F.transform(tokens, lambda t: F.when(F.startswith(v, t), 18).when(F.contains(v, t), 8).otherwise(0)), F.lit(0), lambda a, x: a + x)
    whole = F.when(v == q, 100).otherwise(0) + F.when(F.startswith(v, q), 80).otherwise(0) + F.when(F.contains(v, q), 55).otherwise(0)
    scored = values.select("value").distinct().withColumn("score", whole + per_token).where("score > 0")
    return scored.orderBy(F.col("score").desc(), F.length("value"), "value").limit(most)


def location_index(records: DataFrame) -> DataFrame:
    """(place, n, types, category): records per place and the most frequent category, ties by name."""
    exploded = records.select(F.explode("places").alias("place"), "kind", "category")
    counts = exploded.groupBy("place", "category").agg(F.count("*").alias("n"), F.collect_set("kind").alias("kinds"))
    first = counts.withColumn("place_rank", F.row_number().over(Window.partitionBy("place").orderBy(F.col("n").desc(), "category")))
    return first.groupBy("place").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("types"), F.max(F.when(F.col("place_rank") == 1, F.col("category"))).alias("category"))


def candidate_overview(records: DataFrame, most: int = 10) -> DataFrame:
    """(label, year, n, titles): counts and first titles per decision and year."""
    decided = records.withColumn("label", labels.decision(F.col("status"), labels.archive_record(F.col("kind")))["label"]).withColumn("year", F.substring("date", 1, 4))
    placed = decided.withColumn("place", F.row_number().over(Window.partitionBy("label", "year").orderBy(F.col("date").desc(), "record_id")))
    shown = F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "title"))))
    return placed.groupBy("label", "year").agg(F.count("*").alias("n"), F.array_join(F.transform(shown, lambda x: x["title"]), " | ").alias("titles"))


def seats(members: DataFrame) -> DataFrame:
    """(party, seats, share, total, majority) from (party, name); a name counts once."""
    distinct = members.select("party", "name").distinct()
    counted = distinct.groupBy("party").agg(F.count("*").alias("seats"))
    total = counted.agg(F.sum("seats").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("party", "seats", F.round(F.col("seats") / F.col("total"), 4).alias("share"), "total", (F.floor(F.col("total") / 2) + 1).cast("long").alias("majority"))


def spread_points(points: DataFrame) -> DataFrame:
    """points with lat and lon moved to a ring where an earlier row has the same place, by id."""
    key = [F.round("lat", 5), F.round("lon", 5)]
    n = F.row_number().over(Window.partitionBy(*key).orderBy("id")) - 1
    moved = points.withColumn("n", n)
    angle = ((F.col("n") - 1) % 8) * (F.pi() / 4)
    radius = 0.00032 * (F.floor((F.col("n") - 1) / 8) + 1)
    return moved.withColumn("lat", F.when(F.col("n") > 0, F.col("lat") + radius * F.sin(angle)).otherwise(F.col("lat"))).withColumn("lon", F.when(F.col("n") > 0, F.col("lon") + radius * F.cos(angle)).otherwise(F.col("lon")))


def unique_by(rows: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row of each computed key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def services(rows: DataFrame, category: str, query: str, searched: tuple[str, ...]) -> DataFrame:
    """Services of a category ('' for all) whose columns hold a query."""
    kept = rows.where(F.col("category") == category) if category else rows
    wanted = text.search_text(F.lit(query))
    return kept.where((wanted == "") | F.contains(text.search_text(F.concat_ws(" ", *searched)), wanted))


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with their place in an order, which must be total.

    Rows are dealt by ranges of the order; a partition's rows are numbered on their own and
    behind the sizes of those before it, so that no task sees all.
    """
    dealt = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    own = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = own.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(before.drop("__size"), "__part").withColumn("place", (F.col("__n") + F.col("__before")).cast("int")).drop("__part", "__n", "__before")


def by_point(places: DataFrame, digits: int = 6) -> DataFrame:
    """(lat, lon, n, names) of places (name, lat, lon) that share a point to so many digits."""
    points = places.select(F.round("lat", digits).alias("lat"), F.round("lon", digits).alias("lon"), "name")
    return points.groupBy("lat", "lon").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
