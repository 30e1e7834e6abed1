"""Questions against records: focus, scores, people, citations and the projections behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import text
from quorumlake.operators import search
from quorumlake.storage import stored

#: Least score of an answer source by the number of question words.
MINIMUM_SHARE = 0.35


def question_scores(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, source_id, score, matched): words of a question against sources (source_id, title, body).

    8 for the whole question, 3 for each word in the title, 1 for each word, 4 if
    all occur; a source needs 1 for up to two words, else 35% of the words and at
    least 2. Words meet by equality of folded words, so no pair is made without one.
    """
    asked = stored(queries.select("query_id", text.search_text(F.col("query")).alias("passage"), F.filter(text.query_tokens(F.col("query")), lambda t: F.length(t) >= 4).alias("tokens")), "questions")
    wanted = asked.select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("word"))
    split = lambda c: F.split(text.search_text(c), " ")
    words = sources.select("source_id", F.array_distinct(split(F.concat_ws(" ", "title", "body"))).alias("words"), split(F.col("title")).alias("heads"))
    said = words.select("source_id", "heads", F.explode("words").alias("word"))
    # Only a row for each question and source is dealt out, no text.
    met = said.join(search.sent(wanted, wanted.count()), "word").withColumn("in_title", F.array_contains("heads", F.col("word")).cast("int"))
    hits = met.groupBy("query_id", "source_id", "n").agg(F.count("*").alias("matched"), F.sum("in_title").alias("in_title"))
    texts = sources.select(F.col("source_id").alias("record_id"), text.search_text(F.concat_ws(" ", "title", "body")).alias("text"))
    whole = search.holding(texts, asked.where(F.length("passage") >= 6)).distinct().select("query_id", F.col("record_id").alias("source_id"), F.lit(8).alias("exact"))
    rows = hits.join(whole, ["query_id", "source_id"], "left")
    n = F.col("n")
    score = F.coalesce("exact", F.lit(0)) + 3 * F.col("in_title") + F.col("matched") + F.when(F.col("matched") == n, 4).otherwise(0)
    least = F.when(n <= 2, 1).otherwise(F.greatest(F.lit(2), F.ceil(MINIMUM_SHARE * n)))
    return rows.withColumn("score", score.cast("long")).where(F.col("score") >= least).select("query_id", "source_id", "score", "matched")


def focus_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term): the longest known term whose words all stand in the query in a row; ties by name.

    Terms and queries meet on a term's first word.
    """
    first = terms.select(F.col("term"), text.search_text(F.col("term")).alias("folded")).where("folded <> ''").withColumn("word", F.split("folded", " ")[0])
    asked = queries.select("query_id", text.search_text(F.col("query")).alias("whole"))
    words = asked.select("query_id", "whole", F.explode(F.array_distinct(F.split("whole", " "))).alias("word"))
    met = words.join(first, "word").where(F.contains(F.concat(F.lit(" "), "whole", F.lit(" ")), F.concat(F.lit(" "), "folded", F.lit(" "))))
    best = Window.partitionBy("query_id").orderBy(F.length("folded").desc(), "term")
    return met.withColumn("n", F.row_number().over(best)).where("n = 1").select("query_id", "term")


def contributions(records: DataFrame) -> DataFrame:
    """(person, year, motions, questions, decided, open) of submitters."""
    return records.groupBy("person", "year").agg(
        F.count_if(F.col("kind").isin("urgent_motion", "written_motion", "amendment_motion", "additional_motion")).alias("motions"),
        F.count_if(F.col("kind").isin("written_question", "question_hour")).alias("questions"),
        F.count_if(F.startswith("status", F.lit("accepted"))).alias("decided"),
        F.count_if(F.col("status").isin("unknown", "assigned", "pending")).alias("open"),
    )


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, source_no, place): sources cited as [n] or 'Quelle n', each once, in order."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"(?:\[|Quelle )([0-9]+)"), F.lit(1)), lambda n: n.cast("int")))
    return answers.select("answer_id", F.posexplode(found).alias("place", "source_no")).select("answer_id", "source_no", "place")


def gazetteer(texts: DataFrame, names: DataFrame, most_words: int = 3) -> DataFrame:
    """(id, name, first): known names of up to most_words words in texts (id, text), by their first place.

    Word n-grams meet names by equality.
    """
    words = F.split(text.search_text(F.col("text")), " ")
    rows = texts.select("id", words.alias("w"))
    parts = None
    for n in range(1, most_words + 1):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        one = rows.select("id", "w", F.explode(starts).alias("pos")).select("id", "pos", F.array_join(F.slice("w", F.col("pos"), F.lit(n)), " ").alias("gram"))
        parts = one if parts is None else parts.union(one)
    known = names.select(F.col("name"), text.search_text(F.col("name")).alias("gram")).distinct()
    return parts.join(known, "gram").groupBy("id", "name").agg(F.min("pos").alias("first"))


#: How names of streets and places end.
STREET_END = r"(?:straße|strasse|gasse|weg|platz|allee|kai|gürtel|ring|park|steg|brücke|siedlung|promenade)"


def street_names(texts: DataFrame, names: DataFrame, most_words: int = 5) -> DataFrame:
    """(id, name, first): names (name) of up to most_words words that texts (id, text) hold, with the first word's place.

    Words of a text meet names by their first word; then the words that follow
    are compared. A list of street names joined by hyphens is also taken apart:
    each of its parts may be a name by itself or behind the word before the list,
    which such lists don't repeat.
    """
    joined = F.regexp_replace(text.squeeze(F.col("text")), rf"(?iu)\b([\p{{L}}.]+{STREET_END})\s*[-–]\s*(?=[\p{{L}}])", "$1-")
    bare = lambda w: text.street_name(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    words = texts.select("id", F.transform(F.split(joined, " "), bare).alias("words"))
    known = names.select(text.street_name(F.col("name")).alias("name")).where("name <> ''").distinct().withColumn("parts", F.split("name", " ")).where(F.size("parts") <= most_words)
    known = known.select("name", F.size("parts").alias("n"), F.col("parts")[0].alias("word"))
    each = words.select("id", "words", F.posexplode("words").alias("pos", "word")).where("word <> ''")
    following = each.select("id", "pos", "word", F.slice("words", F.col("pos") + 1, F.lit(most_words)).alias("next"))
    direct = following.join(known, "word").where(F.array_join(F.slice("next", F.lit(1), F.col("n")), " ") == F.col("name")).select("id", "name", "pos")
    listed = each.where(F.rlike("word", F.lit(rf"{STREET_END}[-–].*{STREET_END}$")))
    before = F.when(F.col("pos") > 0, F.element_at("words", F.col("pos"))).otherwise("")
    parts = listed.select("id", "pos", before.alias("before"), F.explode(F.split("word", "[-–]")).alias("part")).where("part <> ''")
    tried = F.array_distinct(F.array(F.col("part"), F.trim(F.concat_ws(" ", "before", "part"))))
    apart = parts.select("id", "pos", F.explode(tried).alias("name")).join(known.select("name"), "name").select("id", "name", "pos")
    return direct.unionByName(apart).groupBy("id", "name").agg((F.min("pos") + 1).alias("first"))


def by_priority(sides: list[DataFrame], key: str) -> DataFrame:
    """The rows of the first side that has a key; within a side, the smallest row."""
    rows = None
    for k, side in enumerate(sides):
        one = side.withColumn("__prio", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    others = [c for c in rows.columns if c not in (key, "__prio")]
    return rows.groupBy(key).agg(F.min(F.struct("__prio", *others)).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in others])


def template_summary(title: Column, person: Column, result: Column) -> Column:
    """One or two sentences from a record's facts."""
    actor = F.when(person != "", F.concat(person, F.lit(" brachte ein: "))).otherwise("")
    return F.concat(actor, title, F.lit("."), F.when(result != "", F.concat(F.lit(" "), result)).otherwise(" Ein Ergebnis liegt noch nicht vor."))


def conclusions(sources: DataFrame, key: str) -> DataFrame:
    """(key, conclusion, rest): what sources (key, title, date, record_id, grp) say: decisions and the latest of them, and the other groups' counts."""

    def n(group: str) -> Column:
        return F.count_if(F.col("grp") == group)

    counted = sources.groupBy(key).agg(
        *[n(g).alias(g) for g in ("decided", "rejected", "open", "treated")],
        F.max_by("title", F.when(F.col("grp") == "decided", F.struct("date", "record_id"))).alias("latest"),
        F.max(F.when(F.col("grp") == "decided", F.col("date"))).alias("day"),
    )
    count = lambda c: F.col(c).cast("string")
    decided = F.concat(count("decided"), F.lit(" belegte Beschlüsse, zuletzt am "), "day", F.lit(": "), "latest", F.lit("."))
    others = [F.when(F.col(c) > 0, F.concat(count(c), F.lit(f" {word}"))) for c, word in (("open", "offen"), ("rejected", "abgelehnt"), ("treated", "behandelt"))]
    conclusion = F.when(F.col("decided") > 0, decided).when(F.col("rejected") + F.col("open") + F.col("treated") > 0, "Kein belegter Beschluss.").otherwise("Kein Treffer.")
    return counted.select(key, conclusion.alias("conclusion"), F.concat_ws(", ", *others).alias("rest"))


def unified_sources(sides: list[DataFrame]) -> DataFrame:
    """(source_id, source, title, context, searched) of all sides (source, key, title, context)."""
    rows = None
    for side in sides:
        one = side.select(F.concat_ws(":", "source", F.col("key").cast("string")).alias("source_id"), "source", text.text(F.col("title")).alias("title"), text.text(F.col("context")).alias("context"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("searched", text.search_text(F.concat_ws(" ", "title", "context")))


def shown_and_rest(results: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, group, shown, rest): a group's first results (query_id, rank, record_id, group), and how many more there are."""
    placed = results.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "group").orderBy("rank")))
    shown = F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("rank", "record_id"))))
    return placed.groupBy("query_id", "group").agg(F.array_join(F.transform(shown, lambda x: x["record_id"]), ",").alias("shown"), F.count_if(F.col("place") > most).alias("rest"))
