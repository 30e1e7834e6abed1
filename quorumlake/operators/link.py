"""Joins across sources: inheritance, merging, near-title and one-to-one linkage."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quorumlake.functions import text
from quorumlake.storage import spread, stored

#: Words too common to tell titles apart.
GENERIC_TOKENS = (
    "abteilung abschluss budgetvorsorge dienststelle ermächtigung ermaechtigung euro feststellung förderung foerderung generalversammlung gemäß gemaess "
    "gmbh höhe hoehe ihv jahr jahre jahresabschluss landeshauptstadt projektgenehmigung richtlinien stadt statut statuts statutes "
    "stimmrechtsermächtigung stimmrechtsermaechtigung umlaufbeschluss vertreter vertreters"
).split()


def first_per_key(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key, by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def inherit(base: DataFrame, donors: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """base with empty columns filled from the first donor with the same keys; blank keys inherit nothing.

    A column is empty if null, '' or an empty array.
    """

    def empty(c: Column, kind: str) -> Column:
        return c.isNull() | ((F.size(c) == 0) if kind.startswith("array") else (c.cast("string") == ""))

    kinds = dict(donors.dtypes)
    blank = F.lit(False)
    for key in keys:
        blank = blank | F.coalesce(F.col(key).cast("string"), F.lit("")).eqNullSafe("")
    useful = F.lit(False)
    for c in columns:
        useful = useful | ~empty(F.col(c), kinds[c])
    first = first_per_key(donors.where(~blank & useful), keys, order).select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = base.join(first, keys, "left")
    return joined.withColumns({c: F.when(empty(F.col(c), kinds[c]), F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)) for c in columns}).select(*base.columns)


def merge_missing(base: DataFrame, extra: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base and the first extra row of each key that base lacks; base itself stays whole."""
    new = first_per_key(extra.join(base.select(*keys).distinct(), keys, "left_anti"), keys, order)
    return base.unionByName(new.select(*base.columns), allowMissingColumns=True)


def merge_by_id(base: DataFrame, extra: DataFrame, id_col: str = "record_id") -> DataFrame:
    """base and the extra rows with an id that base lacks, or with none."""
    known = base.select(F.col(id_col).alias("__id")).distinct()
    new = extra.join(known, F.nullif(F.col(id_col), F.lit("")) == F.col("__id"), "left_anti")
    return base.unionByName(new.select(*base.columns))


def best_link_per_date(links: DataFrame, rank: Column) -> DataFrame:
    return first_per_key(links.withColumn("__rank", rank), ["meeting_date"], "__rank", "title", "url").drop("__rank")


def _shared_words(left: str, right: str) -> int:
    """Distinctive words of both; words of six characters or more also if their own ratio is 0.86 or more."""
    x, y = ({w for w in t.split() if len(w) >= 4 and w not in GENERIC_TOKENS} for t in (left, right))
    both = x & y
    near = sum(any(len(a) >= 6 and len(b) >= 6 and SequenceMatcher(None, a, b).ratio() >= 0.86 for b in y - both) for a in x - both)
    return len(both) + near


@F.pandas_udf(DoubleType())
def matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of two strings."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


#: What an entry of the record's own place adds to a title's score.
ORDER_BONUS = 0.08
_SCORES = StructType([StructField(n, DoubleType()) for n in ("title", "plain", "placed")] + [StructField("distinctive", IntegerType())])


@F.pandas_udf(_SCORES)
def title_scores(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Of two normalised titles: ratio or shared part of the left one's words, the larger; that to three digits, alone and with the bonus; distinctive words shared."""
    out = []
    for a, b in zip(left, right, strict=True):
        x = set(a.split())
        title = max(SequenceMatcher(None, a, b).ratio(), len(x & set(b.split())) / max(len(x), 1)) if a and b else 0.0
        out.append((title, round(min(title, 1.0), 3), round(min(title + ORDER_BONUS, 1.0), 3), _shared_words(a, b)))
    return pd.DataFrame(out, columns=["title", "plain", "placed", "distinctive"])


_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüß "


def letter_counts(value: Column) -> Column:
    """How often each listed letter occurs, and all others together."""
    listed = [F.length(value) - F.length(F.replace(value, F.lit(c), F.lit(""))) for c in _LETTERS]
    return F.array(*listed, F.length(F.regexp_replace(value, "[a-zäöüß ]", "")))


def ratio_bound(left: Column, right: Column) -> Column:
    """No matching-block ratio of two strings with these letter counts is above this: twice the letters that both have, over all letters."""

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0), lambda x, y: x + y)

    return 2 * total(F.zip_with(left, right, lambda x, y: F.least(x, y))) / F.greatest(total(left) + total(right), F.lit(1))


def token_overlap(left: Column, right: Column) -> Column:
    """Shared words over the left side's words, of normalised texts."""
    a, b = F.array_distinct(F.split(left, " ")), F.array_distinct(F.split(right, " "))
    return F.when((left == "") | (right == ""), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


#: A title within another one counts as near from so many characters, with this score.
CONTAINED_LENGTH, CONTAINED_SCORE = 16, 0.9


def grams(value: Column) -> Column:
    """The pairs of successive characters, the n-th of its kind named by n."""
    plain = F.transform(F.sequence(F.lit(1), F.greatest(F.length(value) - 1, F.lit(1))), lambda i: F.substring(value, i, F.lit(2)))
    return F.transform(plain, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(plain, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def _gram_index(titles: DataFrame, least: float) -> DataFrame:
    """titles (block's columns and title) plus grams, the rarest over all titles first, and prefix: how many of them two titles of a ratio of least can't do without.

    M characters in matching blocks leave s - 2M others, of the s that both
    titles have, and at most one block more than those; each block of m
    characters has m - 1 pairs. So 3M - s - 1 pairs at least are shared.
    """
    listed = titles.withColumn("grams", grams(F.col("title")))
    rarity = listed.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    each = titles.columns
    ordered = (
        listed.select(*each, F.explode("grams").alias("gram"))
        .join(rarity, "gram")
        .groupBy(*each)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"]).alias("grams"))
    )
    # The shortest partner has least / (2 - least) of the title's length.
    shared = F.ceil((1.5 * least - 1) * F.length("title") * (1 + least / (2 - least)) - 1 - 1e-9)
    return ordered.withColumn("prefix", F.greatest(F.lit(1), F.least(F.size("grams"), F.size("grams") - shared + 1)).cast("int"))


def same_title_pairs(left: DataFrame, right: DataFrame, block: list[str]) -> DataFrame:
    """(block's columns, a, b): pairs of titles that are equal, or one of which, of CONTAINED_LENGTH characters or more, lies within the other.

    Both have the block's columns and title, distinct. A title lies only in those that have its last characters.
    """
    a, b = left.select(*block, F.col("title").alias("a")), right.select(*block, F.col("title").alias("b"))
    windows = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - CONTAINED_LENGTH + 1), lambda i: F.substring(c, i, F.lit(CONTAINED_LENGTH))))

    def within(inner: DataFrame, short: str, outer: DataFrame, long: str) -> DataFrame:
        ends = inner.where(F.length(short) >= CONTAINED_LENGTH).select("*", F.substring(short, -CONTAINED_LENGTH, CONTAINED_LENGTH).alias("key"))
        held = outer.where(F.length(long) > CONTAINED_LENGTH).select("*", F.explode(windows(F.col(long))).alias("key"))
        return ends.join(held, [*block, "key"]).where((F.length(long) > F.length(short)) & F.contains(long, short)).select(*block, "a", "b")

    equal = a.join(b.withColumn("a", F.col("b")), [*block, "a"]).select(*block, "a", "b")
    return within(a, "a", b, "b").unionByName(within(b, "b", a, "a")).unionByName(equal)


def near_title_pairs(left: DataFrame, right: DataFrame, block: list[str], least: float) -> DataFrame:
    """(block's columns, a, b): pairs of distinct titles that may have a ratio of least, or one of which lies within the other, or that are equal.

    Both have the block's columns and title, distinct and not empty. Candidates
    share a block and one of the rare pairs of characters of both; what shares
    too few of all pairs, or differs too much in length, letters or edit distance,
    goes before any ratio is worked out. No pair that has it is lost.
    """
    if least <= 2 / 3:
        raise ValueError("pairs of characters bound ratios above two thirds only")
    both = left.withColumn("__left", F.lit(True)).unionByName(right.withColumn("__left", F.lit(False)))
    both = stored(_gram_index(both, least).withColumn("letters", letter_counts(F.col("title"))), "similar-grams")

    def side(is_left: bool, name: str) -> DataFrame:
        rows = both.where(F.col("__left") == is_left)
        return rows.select(*block, F.col("title").alias(name), F.col("grams").alias(f"{name}_grams"), F.col("prefix").alias(f"{name}_prefix"), F.col("letters").alias(f"{name}_letters"))

    a, b = side(True, "a"), side(False, "b")
    # Two titles of no more characters together may share single letters only.
    short = int(1 / (1.5 * least - 1) + 1e-9)
    keys = lambda n: F.concat(F.slice(f"{n}_grams", F.lit(1), F.col(f"{n}_prefix")), F.when(F.length(n) < short, F.split(F.col(n), "")).otherwise(F.array().cast("array<string>")))
    met = a.select(*block, "a", F.explode(F.array_distinct(keys("a"))).alias("key")).join(b.select(*block, "b", F.explode(F.array_distinct(keys("b"))).alias("key")), [*block, "key"])
    near = met.select(*block, "a", "b").distinct().join(a, [*block, "a"]).join(b, [*block, "b"])
    size = F.length("a") + F.length("b")
    alike = (2 * F.least(F.length("a"), F.length("b")) >= least * size - 1e-9) & (F.size(F.array_intersect("a_grams", "b_grams")) >= (1.5 * least - 1) * size - 1 - 1e-9)
    near = near.where(alike & (ratio_bound(F.col("a_letters"), F.col("b_letters")) >= least)).select(*block, "a", "b")
    # What isn't matched is taken out or put in, so that an edit distance is no longer.
    near = near.where(F.levenshtein("a", "b") <= (1 - least) * size + 1e-9)

    return near.unionByName(same_title_pairs(left, right, block)).distinct()


def similar_titles(left: DataFrame, right: DataFrame, block: list[str], fuzzy: bool = True, least: float = 0.78) -> DataFrame:
    """(left_id, right_id, score): each left row's best right row in its block.

    1 for equal titles, 0.9 for one of 16 characters or more within the other,
    else the matching-block ratio (if fuzzy), worked out once for each pair of
    distinct titles that an index of character pairs finds. Both sides have id,
    title and the block's columns. The smaller right id wins ties.
    """
    a = stored(left.select(*block, F.col("id").alias("left_id"), text.identity_title(F.col("title")).alias("a")).where("a <> ''"), "similar-left")
    b = stored(right.select(*block, F.col("id").alias("right_id"), text.identity_title(F.col("title")).alias("b")).where("b <> ''"), "similar-right")
    # Of a title's rows in a block the two smallest ids are enough: one may be the left row itself.
    first = stored(b.withColumn("n", F.row_number().over(Window.partitionBy(*block, "b").orderBy("right_id"))).where("n <= 2").drop("n"), "similar-first")
    titles = lambda rows, name: rows.select(*block, F.col(name).alias("title")).distinct()

    def best(rows: DataFrame, scored: DataFrame) -> DataFrame:
        met = scored.join(first, [*block, "b"])
        ranked = met.withColumn("n", F.row_number().over(Window.partitionBy(*block, "a").orderBy(F.col("score").desc(), "right_id"))).where("n <= 2").drop("n", "b")
        return first_per_key(rows.join(ranked, [*block, "a"]).where("left_id <> right_id"), ["left_id"], F.col("score").desc(), "right_id").select("left_id", "right_id", "score")

    plain = same_title_pairs(titles(a, "a"), titles(b, "b"), block).distinct().withColumn("score", F.when(F.col("a") == F.col("b"), 1.0).otherwise(CONTAINED_SCORE))
    plain = stored(plain, "similar-plain")
    held = plain.where(F.col("score") >= least)
    sure = best(a, held)
    if not fuzzy:
        return sure
    # No other title is nearer than an equal one. Where one lies within the other, a ratio of less than its score changes nothing.
    sure = stored(sure, "similar-sure")
    rest = stored(a.join(sure.select("left_id", "score"), "left_id", "left").where("score IS NULL OR score < 1"), "similar-rest")
    needed = rest.groupBy(*block, "a").agg(F.min(F.coalesce("score", F.lit(least))).alias("needed"))
    near = near_title_pairs(titles(rest, "a"), titles(b, "b"), block, least).where(F.col("a") != F.col("b")).join(needed, [*block, "a"])
    near = near.join(plain.select(*block, "a", "b"), [*block, "a", "b"], "left_anti").where(F.levenshtein("a", "b") <= (1 - F.col("needed")) * (F.length("a") + F.length("b")) + 1e-9)
    scored = spread(near.select(*block, "a", "b")).withColumn("score", matching_ratio("a", "b")).where(F.col("score") >= least)
    found = best(rest.drop("score"), scored.unionByName(held.select(*scored.columns)))
    return sure.where("score >= 1").unionByName(found)


#: Least scores of a link: agenda items of the same number, any title, titles of the same order.
AGENDA_LEAST, TITLE_LEAST, ORDER_LEAST = 0.5, 0.55, 0.5
#: A link to an entry without a result is kept from this score.
WITHOUT_RESULT_LEAST = 0.7


def link_candidates(records: DataFrame, entries: DataFrame, block: list[str], agenda: str) -> DataFrame:
    """Pairs of records and entries of a block whose titles may be near enough, with what a choice needs.

    Both have the block's columns, id, title and item_no. Distinct pairs of titles are
    scored, those first dropped whose letters or words differ too much.
    """

    def side(rows: DataFrame, prefix: str, *extra: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*block).orderBy("item_no", "id"))
        named = rows.select(*block, *extra, F.col("id").cast("long").alias(f"{prefix}id"), text.match_text(F.col("title")).alias(f"{prefix}norm"), F.col("item_no").alias(f"{prefix}item_no"), place.cast("long").alias(f"{prefix}place"))
        return named.where(F.col(f"{prefix}norm") != "")

    a, b = stored(side(records, "", F.expr(agenda).alias("agenda")), "link-records"), stored(side(entries, "entry_"), "link-entries")
    least = ORDER_LEAST - ORDER_BONUS

    def titles(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*block, name).distinct().withColumn(f"{name}_letters", letter_counts(F.col(name)))

    pairs = titles(a, "norm").join(titles(b, "entry_norm"), block)
    near = pairs.where((token_overlap(F.col("norm"), F.col("entry_norm")) >= least) | (ratio_bound(F.col("norm_letters"), F.col("entry_norm_letters")) >= least))
    scored = near.select(*block, "norm", "entry_norm", title_scores("norm", "entry_norm").alias("s")).where(F.col("s.title") >= least)
    same = F.col("place") == F.col("entry_place")
    score = F.when(same, F.col("s.placed")).otherwise(F.col("s.plain"))
    full = scored.join(a, [*block, "norm"]).join(b, [*block, "entry_norm"])
    numbered = F.col("agenda") & F.col("item_no").eqNullSafe(F.col("entry_item_no"))
    sure = ~F.col("agenda") | numbered | (F.col("s.distinctive") >= 2) | ((score >= 0.8) & (F.col("s.distinctive") >= 1))
    accepted = ((score >= TITLE_LEAST) & sure) | (F.col("agenda") & (score >= AGENDA_LEAST) & (F.col("s.distinctive") >= 2)) | (~F.col("agenda") & same & (score >= ORDER_LEAST))
    return full.select(
        F.col("id").alias("record_id"),
        "entry_id",
        "place",
        "entry_place",
        (numbered & (F.col("s.title") >= AGENDA_LEAST)).alias("numbered"),
        F.col("s.title").alias("title"),
        F.col("s.plain").alias("plain"),
        F.least(F.col("s.title") + F.when(same, ORDER_BONUS).otherwise(0.0), F.lit(1.0)).alias("whole"),
        score.alias("score"),
        accepted.alias("accepted"),
    )


def choices(free: DataFrame) -> DataFrame:
    """(record_id, place, entry_id, score, accepted): the entry that decides for each record among its free ones.

    An entry of the same number comes first, by title; else the best by title and
    place, whether it is good enough or not. Earlier entries win ties.
    """
    by_number = F.max(F.when(F.col("numbered"), F.struct("title", (-F.col("entry_place")).alias("o"), "entry_id", F.col("plain").alias("score"), F.lit(True).alias("accepted"))))
    by_title = F.max(F.struct("whole", (-F.col("entry_place")).alias("o"), "entry_id", "score", "accepted"))
    found = free.groupBy("record_id", "place").agg(by_number.alias("n"), by_title.alias("t"))
    return found.select("record_id", "place", *[F.coalesce(F.col(f"n.{c}"), F.col(f"t.{c}")).alias(c) for c in ("entry_id", "score", "accepted")])


def link_one_to_one(records: DataFrame, entries: DataFrame, block: list[str], agenda: str = "kind = 'agenda_item'") -> DataFrame:
    """(record_id, entry_id, score): one-to-one linkage within blocks by item number, title and order, as if records chose in turn.

    Rounds of deferred acceptance: each record turns to the entry that decides for
    it among those that no earlier record of its block holds; an entry is held
    by the earliest record that would take it. A holder only ever gives way to an
    earlier one, so what a record has lost never comes free again, and when a
    round changes no holder everybody has what a choice in turn would give. A
    record that finds its deciding entry not good enough stays without one,
    unless an earlier record takes that entry away. No block lies in one task:
    a round is a join by entry and an aggregation by record.
    """
    spark = records.sparkSession
    pairs = stored(link_candidates(records, entries, block, agenda), "link-pairs")
    held = spark.createDataFrame([], "entry_id long, holder long, holder_place long, score double")
    while True:
        free = pairs.join(held.select("entry_id", "holder_place"), "entry_id", "left").where("holder_place IS NULL OR holder_place >= place")
        offers = choices(free).where("accepted")
        first = offers.groupBy("entry_id").agg(F.min_by(F.struct("record_id", "place", "score"), "place").alias("h"))
        after = stored(first.select("entry_id", F.col("h.record_id").alias("holder"), F.col("h.place").alias("holder_place"), F.col("h.score").alias("score")), "link-held")
        same = after.join(held, ["entry_id", "holder"], "left_anti").isEmpty() and after.count() == held.count()
        held = after
        if same:
            return held.select(F.col("holder").alias("record_id"), "entry_id", "score")


def near_words(words: DataFrame, column: str, short: int = 14) -> DataFrame:
    """(a, b, n): distinct words a < b within an edit distance of 1, or of 2 if a has short characters or more.

    Words meet by what is left of them without up to two of their characters, so
    that only words that can be near are compared.
    """
    gone = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = gone(F.col(column))
    # Words of short - 2 characters or more may be near one that allows two edits.
    two = F.when(F.length(column) >= short - 2, F.flatten(F.transform(one, gone))).otherwise(F.array().cast("array<string>"))
    keys = words.select(column, F.explode(F.array_distinct(F.concat(F.array(column), one, two))).alias("key"))
    other = keys.select(F.col(column).alias("b"), "key")
    pairs = keys.withColumnRenamed(column, "a").join(other, "key").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("n", F.levenshtein("a", "b")).where(F.col("n") <= F.when(F.length("a") >= short, 2).otherwise(1))


def related(rows: DataFrame, most: int = 6) -> DataFrame:
    """(id, related): up to six other records that share a number or a place, by date and title, as id list.

    rows has id, date, title, numbers and places. Keys are exploded and joined on
    equality; a pair counts once however many keys it shares.
    """
    keys = rows.select("id", "date", "title", F.explode(F.concat(F.transform("numbers", lambda x: F.concat(F.lit("n:"), x)), F.transform("places", lambda x: F.concat(F.lit("p:"), F.lower(x))))).alias("key")).distinct()
    # The first most + 1 rows of a key hold its first most others of any row, so a key of many records costs few pairs.
    first = keys.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("date", "title", "id"))).where(F.col("n") <= most + 1)
    other = first.select("key", F.col("id").alias("other"), F.col("date").alias("other_date"), F.col("title").alias("other_title"))
    pairs = keys.select("id", "key").join(other, "key").where("id <> other").select("id", "other", "other_date", "other_title").distinct()
    placed = pairs.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("other_date", "other_title", "other"))).where(F.col("place") <= most)
    return placed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"].cast("string")), ",").alias("related"))


#: So many names or subscriptions are sent to all works; of more, each meets so many parts of the works.
MOST_SENT, COPIES = 200_000, 64


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def subscribed(works: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(sub, id): works (id, text, start_date, end_date) that subscriptions (sub, street, district, start_date, end_date) match.

    A work matches if its text holds street and district, whatever their case, and
    its period meets the subscription's; what is null or empty asks for nothing.
    Distinct names meet texts by one of their sequences of three characters, that
    which the fewest works have; shorter names meet them by themselves, and those that ask for nothing meet all.
    What a work holds then meets the subscriptions of that name, whose periods are
    compared. Subscriptions are sent to the works, or dealt out with copies of
    them if there are many, so that a name's works never lie in one task.
    """
    blank = lambda c: F.lower(text.text(F.col(c)))
    runs = lambda x, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))
    w = stored(works.select("id", blank("text").alias("text"), F.col("start_date").cast("date").alias("begins"), F.col("end_date").cast("date").alias("ends")), "works")
    s = stored(subscriptions.select("sub", blank("street").alias("street"), blank("district").alias("district"), F.col("start_date").cast("date").alias("start_date"), F.col("end_date").cast("date").alias("end_date")), "subscriptions")
    names = s.select("street", "district").distinct().withColumn("name", F.when(F.length("street") >= F.least(F.length("district"), F.lit(3)), F.col("street")).otherwise(F.col("district")))
    keys = stored(names.select("street", "district", F.explode(F.array_distinct(runs(F.col("name"), 3))).alias("key")), "name-keys")
    lengths = {r.n for r in keys.select(F.length("key").alias("n")).distinct().collect()}
    parts = [runs(F.col("text"), n) for n in sorted({3} | lengths - {0})]
    held = w.select("id", "text", "begins", "ends", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *parts))).alias("key"))
    rarity = held.select("key").join(_sent(keys.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("n"))
    # A sequence that no work has comes first: such a name meets nothing.
    one = keys.join(rarity, "key", "left").groupBy("street", "district").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "key")).getField("key").alias("key"))
    holds = F.contains("text", "street") & F.contains("text", "district")
    met = held.join(_sent(stored(one, "names")), "key").where(holds).select("id", "begins", "ends", "street", "district")
    meets = ~(F.coalesce(F.col("ends") < F.col("start_date"), F.lit(False)) | F.coalesce(F.col("begins") > F.col("end_date"), F.lit(False)))
    if s.count() <= MOST_SENT:
        pairs = met.join(F.broadcast(s), ["street", "district"])
    else:
        copies = s.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        pairs = met.withColumn("part", F.pmod(F.hash("id"), F.lit(COPIES))).join(copies, ["street", "district", "part"])
    return pairs.where(meets).select("sub", "id")


def apply_proposals(rows: DataFrame, proposals: DataFrame, key: str, column: str, valid: Column) -> DataFrame:
    """rows with column replaced where a valid proposal exists; rule_<column> keeps the old value, <column>_source says which it is."""
    offered = proposals.where(valid).select(F.col(key), F.col("proposal"))
    joined = rows.join(offered, key, "left")
    taken = F.col("proposal").isNotNull()
    return joined.select(
        *[c for c in rows.columns if c != column],
        F.col(column).alias(f"rule_{column}"),
        F.coalesce("proposal", column).alias(column),
        F.when(taken, "proposal").otherwise("rule").alias(f"{column}_source"),
    )


def nearby(places: DataFrame, works: DataFrame, most: int = 30) -> DataFrame:
    """(place, id): the first works (id, text) that have a word of four characters or more of a place's name.

    Words meet by equality; a word's first works are enough, whatever a place's other words find.
    """
    wanted = places.select("place", F.explode(F.filter(F.split(F.lower("place"), " "), lambda t: F.length(t) >= 4)).alias("word"))
    said = works.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
    first = said.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy("id"))).where(F.col("n") <= most).drop("n")
    met = wanted.join(first, "word").select("place", "id").distinct()
    return met.withColumn("n", F.row_number().over(Window.partitionBy("place").orderBy("id"))).where(F.col("n") <= most).drop("n")


def backfilled(rows: DataFrame, known: DataFrame, key: str, columns: list[str], most: int) -> DataFrame:
    """rows with known's columns where a row has none, and todo: whether it is among the first most, by key, that still lack one of them."""
    joined = rows.join(known.select(key, *[F.col(c).alias(f"__{c}") for c in columns]), key, "left")
    filled = joined.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"__{c}"), F.lit("")), F.lit("")) for c in columns}).drop(*[f"__{c}" for c in columns])
    lacking = F.lit(False)
    for c in columns:
        lacking = lacking | (F.col(c) == "")
    first = filled.where(lacking).select(key).distinct().orderBy(key).limit(most).withColumn("todo", F.lit(True))
    return filled.join(first, key, "left").withColumn("todo", F.coalesce("todo", F.lit(False)))
