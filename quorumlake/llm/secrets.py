"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regex gives a Boolean query of trigrams that any match must hold.
Postings (trigram, document) are kept for the trigrams of these queries,
intersected per document, and the documents that satisfy a rule's query are
verified with its regex. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parsed
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise


@dataclass(frozen=True)
class Rule:
    """kind, Java regex, the group that is measured, and its least length; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run of these characters is matched whole or not at all, so its least length can stand in the regex.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What the method adds to the base kinds.
ADDED = (
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + ADDED

#: The most strings that a stretch of a regex may stand for before it is cut.
MOST_STRINGS = 64
Query = frozenset  # of alternatives, each a frozenset of trigrams that must all occur


def _and(x: Query, y: Query) -> Query:
    return frozenset(a | b for a in x for b in y)


def _of_strings(strings: set[str]) -> Query:
    """Any of the strings occurs: alternatives of all of one's trigrams."""
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


ANY: Query = frozenset({frozenset()})


def trigram_query(pattern: str) -> Query:
    """What every match of pattern must hold, in lower case; ANY if nothing is mandatory."""

    def walk(items) -> tuple[Query, set[str] | None]:
        """The query of a sequence, and its strings if they are few."""
        query, strings, exact = ANY, {""}, True
        for kind, value in items:
            here: set[str] | None = None
            if kind is op.LITERAL:
                here = {chr(value).lower()}
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
                here = {chr(c).lower() for _, c in value}
            elif kind is op.SUBPATTERN:
                inner, here = walk(value[-1])
                query = _and(query, inner)
            elif kind is op.BRANCH:
                sides = [walk(side) for side in value[1]]
                query = _and(query, frozenset().union(*(q for q, _ in sides)))
                here = set().union(*(s for _, s in sides)) if all(s is not None for _, s in sides) else None
            elif kind is op.MAX_REPEAT and value[1] == 1:
                _, inside = walk(value[2])
                here = None if inside is None else inside | ({""} if value[0] == 0 else set())
            elif kind is op.MAX_REPEAT and value[0] > 0:
                query = _and(query, walk(value[2])[0])
            if here is not None and len(strings) * len(here) <= MOST_STRINGS:
                strings = {a + b for a in strings for b in here}
            else:
                query, exact = _and(query, _of_strings(strings)), False
                strings = here if here is not None and len(here) <= MOST_STRINGS else {""}
        return _and(query, _of_strings(strings)), strings if exact else None

    query, _ = walk(parsed.parse(pattern))
    return frozenset(a for a in query if not any(b < a for b in query))  # the weakest alternatives imply the rest


QUERIES = {rule.kind: trigram_query(rule.pattern) for rule in RULES}
INDEXED = sorted(set().union(*(side for query in QUERIES.values() if query != ANY for side in query)))


def _satisfies(held: Column, query: Query) -> Column:
    sides = [F.size(F.array_intersect(held, F.array(*map(F.lit, sorted(side))))) == len(side) for side in sorted(query, key=sorted)]
    return reduce(lambda a, b: a | b, sides)


SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"
#: Values that are added up one by one; an aggregate copies what it has so far for each of them.
LOT = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints what join makes of all before it, from 0; lots first, then their totals."""

    def upto(lot: Column, own: Callable[[Column], Column]) -> Column:
        return F.aggregate(lot, F.array(F.lit(0)), lambda held, x: F.concat(held, F.array(join(F.element_at(held, -1), own(x)))))

    def placed(made: Column) -> Column:
        totals = upto(made, lambda m: F.element_at(m, -1))
        return F.flatten(F.zip_with(made, F.slice(totals, F.lit(1), F.size(made)), lambda m, base: F.transform(F.slice(m, F.lit(1), F.size(m) - 1), lambda x: join(base, x))))

    def lots(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / LOT).cast("int"))
        return F.transform(numbers, lambda k: upto(F.slice(v, k * LOT + 1, F.lit(LOT)), lambda x: x))

    return F.when(F.size(values) > 0, _let(_let(values, lots), placed)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """A rule's leftmost non-overlapping matches, in code points.

    A text split at the matches gives what lies between them; running lengths of
    both give the positions.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    lengths = F.zip_with(found, measured, lambda m, g: F.struct(F.length(m).alias("whole"), F.length(g).alias("part")))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    rows = F.zip_with(gaps, lengths, lambda gap, m: F.struct(F.length(gap).alias("gap"), m["whole"].alias("whole"), m["part"].alias("part")))

    def placed(x: Column) -> Column:
        before = _before(F.transform(x, lambda r: r["gap"] + r["whole"]), lambda a, b: a + b)
        spans = F.zip_with(
            x,
            before,
            lambda r, at: F.struct((at + r["gap"]).alias("start"), F.lit(order).alias("ord"), (at + r["gap"] + r["whole"]).alias("end"), F.lit(rule.kind).alias("kind"), r["part"].alias("part")),
        )
        long_enough = F.filter(spans, lambda r: r["part"] >= rule.least)
        return F.transform(long_enough, lambda r: F.struct(*[r[c].alias(c) for c in ("start", "ord", "end", "kind")]))

    return F.when(F.size(found) > 0, _let(rows, placed)).otherwise(F.array().cast(SPANS))


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", found_col: str = "found") -> DataFrame:
    """The input's columns and found_col: all spans, by start and then rule order.

    A null or empty text has none. Rows that share an id share postings, and each is
    verified on its own text; rows with a null id keep their result too, as do
    repeated rows. An empty table gives no rows. The time for a text grows with its
    length and its matches alike. An input's column named found_col is replaced;
    others may have any name.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = documents.select(F.col(id_col).alias("id"), F.lower(text).alias("low"))
    hits = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in INDEXED]))
    postings = low.select("id", F.explode(hits).alias("trigram"))
    held = postings.groupBy("id").agg(F.collect_set("trigram").alias("held"))
    indexed = [r.kind for r in RULES if QUERIES[r.kind] != ANY]
    verify = F.array_compact(F.array(*[F.when(_satisfies(F.col("held"), QUERIES[kind]), F.lit(kind)) for kind in indexed]))
    own, rules = free_name("id", documents), free_name("rules", documents)
    candidates = materialise(held.select(F.col("id").alias(own), verify.alias(rules)).where(F.size(rules) > 0), "op9-candidates")
    joined = documents.join(candidates, F.col(id_col).eqNullSafe(F.col(own)), "left")
    parts = [
        F.when(F.array_contains(rules, F.lit(r.kind)), _spans(text, r, k)).otherwise(F.array().cast(SPANS)) if r.kind in indexed else _spans(text, r, k)
        for k, r in enumerate(RULES)
    ]
    return joined.select(*[documents[f"`{c}`"] for c in documents.columns if c != found_col], F.array_sort(F.concat(*parts)).alias(found_col))


def span_text(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


#: Code points of the parts in which a text is cut, so that no stretch is searched for from the text's start.
PART = 4096


def masked(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by mask."""

    def between(parts: Column, a: Column, b: Column) -> Column:
        """Code points a to b."""
        i, j = F.floor(a / PART).cast("int"), F.floor(b / PART).cast("int")
        first, last = F.coalesce(F.get(parts, i), F.lit("")), F.coalesce(F.get(parts, j), F.lit(""))
        inside = F.substring(first, a % PART + 1, b - a)
        over = F.concat(F.substring(first, a % PART + 1, F.lit(PART)), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), b % PART))
        return F.when(i == j, inside).otherwise(over)

    def whole(parts: Column) -> Column:
        reach = _before(F.transform(found, lambda x: x["end"]), F.greatest)
        pieces = F.zip_with(found, reach, lambda x, at: F.when(x["start"] >= at, F.concat(between(parts, at, x["start"]), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), between(parts, F.array_max(F.transform(found, lambda x: x["end"])), F.length(text)))

    return F.when(F.size(found) > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), whole)).otherwise(text)
