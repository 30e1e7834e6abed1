"""Recurring topics: file numbers and title words that come up at several meetings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import text

#: Words that make no topic.
STOPWORDS = (
    "der die das und von für fuer mit eine einer eines den dem des stadt beschluss genehmigung projektgenehmigung protokoll protokolle öffentlichen "
    "oeffentlichen nichtöffentlichen nichtoeffentlichen sitzung april dezember jänner jaenner januar februar märz maerz mai juni juli august september "
    "oktober november änderung aenderung entwurf auflage jahre jahr nicht hoehe höhe betr betrag lcf anpassung anpassungen adaptierung"
).split()
MOST_TOPICS = 200


def keywords(title: Column) -> Column:
    """The first four distinct words of six characters or more."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text.text(title)), r"[^\p{L}\p{N}_-]+", " ")), " +")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 6) & ~w.isin(*STOPWORDS))), 1, 4)


def noise(kind: Column, title: Column) -> Column:
    """Archive stubs and approvals of minutes."""
    return (kind == "archive_source") | F.rlike(F.lower(text.text(title)), F.lit(r"(auflage|genehmigung) der protokolle|protokolle der (nicht)?öffentlichen"))


def on_several_dates(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, n, dates, first_date, last_date) of keys that come up on several dates."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("date").alias("dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).where(F.col("dates") >= least)


def candidates(records: DataFrame, most: int = MOST_TOPICS) -> DataFrame:
    """(topic, kind, n, dates, first_date, last_date, confidence, rank) of keys seen on two dates or more.

    records has id, kind, date, title and numbers. Confidence is 0.95 for a file
    number, else 0.45 and 0.08 for each record, at most 0.85.
    """
    kept = records.where(~noise(F.col("kind"), F.col("title")))
    keys = F.concat(F.transform("numbers", lambda n: F.struct(F.lit("business").alias("kind"), n.alias("topic"))), F.transform(keywords(F.col("title")), lambda w: F.struct(F.lit("keyword").alias("kind"), w.alias("topic"))))
    exploded = kept.select("id", "date", F.inline(keys))
    grouped = on_several_dates(exploded, ["kind", "topic"])
    confidence = F.when(F.col("kind") == "business", 0.95).otherwise(F.round(F.least(F.lit(0.85), 0.45 + 0.08 * F.col("n")), 4))
    scored = grouped.withColumn("confidence", confidence)
    top = scored.orderBy(F.col("confidence").desc(), "topic", "kind").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("confidence").desc(), "topic", "kind")))


def shared_tokens(titles: DataFrame, most: int = 8) -> DataFrame:
    """(topic, label): words that all titles of a topic but one have, in the first title's order.

    titles has topic, id and title; the smallest id is the first title.
    """
    words = F.filter(F.split(F.trim(F.regexp_replace(text.fold(F.col("title")), r"[^\p{L}\p{N}-]+", " ")), " +"), lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS) & ~F.rlike(w, F.lit("[0-9]")))
    exploded = titles.select("topic", "id", F.posexplode(words).alias("pos", "word"))
    spread = exploded.groupBy("topic", "word").agg(F.count_distinct("id").alias("df"), F.min(F.struct("id", "pos")).alias("first"))
    sizes = titles.groupBy("topic").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first_id")).where("n >= 2")
    common = spread.join(sizes, "topic").where((F.col("df") >= F.greatest(F.lit(2), F.col("n") - 1)) & (F.col("first.id") == F.col("first_id")))
    placed = common.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy("first.pos", "word"))).where(F.col("place") <= most)
    return placed.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("label"))


def news_scores(topics: DataFrame, news: DataFrame, most: int = 4) -> DataFrame:
    """(topic_id, news_id, score): the share of a topic's words that a news text has; the best four.

    topics has topic_id and label, news has news_id, date and body. Words meet by equality.
    """
    words = F.array_distinct(F.filter(F.split(text.search_text(F.col("label")), " "), lambda w: F.length(w) >= 6))
    wanted = topics.select("topic_id", F.size(words).alias("of"), F.explode(words).alias("word"))
    said = news.select("news_id", "date", F.explode(F.array_distinct(F.split(text.search_text(F.col("body")), " "))).alias("word"))
    hits = wanted.join(said, "word").groupBy("topic_id", "news_id", "of", "date").agg(F.count("*").alias("n"))
    placed = hits.withColumn("score", F.round(F.col("n") / F.col("of"), 4)).withColumn("place", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.col("score").desc(), "date", "news_id")))
    return placed.where(F.col("place") <= most).select("topic_id", "news_id", "score", "place")
