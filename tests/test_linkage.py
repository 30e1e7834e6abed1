"""Near titles and one-to-one linkage over whole tables, against plain loops."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import text
from quorumlake.operators import link
from quorumlake.plans import inputs, queries

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sides(spark):
    week = F.date_trunc("week", "date").cast("string").alias("week")
    columns = ["id", "date", week, "kind", "item_no", text.identity_title(F.col("title")).alias("same"), text.match_text(F.col("title")).alias("norm")]
    return [[r.asDict() for r in rows.select(*columns).collect()] for rows in (inputs.records(spark, FOLDER), queries.second_source(spark, FOLDER))]


def near(a, b):
    if a == b:
        return 1.0
    if (len(a) >= 16 and a in b) or (len(b) >= 16 and b in a):
        return 0.9
    m = SequenceMatcher(None, a, b)
    return m.ratio() if m.real_quick_ratio() >= 0.78 else 0.0


def test_similar_titles_equal_the_plain_loop(spark, sides):
    by_date = defaultdict(list)
    for e in sorted(sides[1], key=lambda e: e["id"]):
        by_date[e["date"]].append(e)
    expected = {}
    for r in sides[0]:
        if r["kind"] in ("question_hour", "written_question") and r["same"]:
            scored = [(near(r["same"], e["same"]), e["id"]) for e in by_date[r["date"]] if e["same"]]
            score, entry = max(scored, key=lambda x: (x[0], -x[1]), default=(0, 0))
            if score >= 0.78:
                expected[r["id"]] = (entry, round(score, 9))
    got = {r.left_id: (r.right_id, round(r.score, 9)) for r in queries.j6_similar_titles(spark, FOLDER).collect()}
    assert got == expected
    assert len(expected) > 1000 and len({s for _, s in expected.values()}) > 10


def test_most_scored_pairs_are_near(spark, sides):
    """These titles are much alike: a fifth of all pairs is near, and no more than as many others are scored."""
    frames = [spark.createDataFrame(sorted({(r["same"], "all") for r in side if r["same"]}), "title string, block string").where("crc32(title) % 8 = 0") for side in sides]
    found = [near(r.a, r.b) >= 0.78 for r in link.near_title_pairs(*frames, ["block"], 0.78).collect()]
    assert found.count(True) >= found.count(False)


def test_the_gram_index_loses_no_pair(spark):
    rng = random.Random(3)

    def title():
        base = "".join(rng.choice("abcdä ") for _ in range(rng.choice((1, 2, 3, 4, 6, 10, 20, 40)))).strip()
        return base or "x"

    left = {title() for _ in range(150)}
    right = {"".join(c for c in t if rng.random() > 0.15) or "y" for t in left} | {title() + rng.choice(sorted(left)) for _ in range(60)} | {title() for _ in range(60)}
    frames = [spark.createDataFrame([(t, 1) for t in sorted(side)], "title string, block int") for side in (left, right)]
    for least in (0.7, 0.78, 0.95):
        found = {(r.a, r.b) for r in link.near_title_pairs(*frames, ["block"], least).collect()}
        needed = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= least or (len(a) >= 16 and a in b) or (len(b) >= 16 and b in a)}
        assert needed <= found and needed
    with pytest.raises(ValueError, match="two thirds"):
        link.near_title_pairs(*frames, ["block"], 0.6)


def like(a, b):
    x = set(a.split())
    return max(SequenceMatcher(None, a, b).ratio(), len(x & set(b.split())) / max(len(x), 1))


def shared(a, b):
    x, y = ({w for w in t.split() if len(w) >= 4 and w not in link.GENERIC_TOKENS} for t in (a, b))
    both = x & y
    return len(both) + sum(any(min(len(u), len(v)) >= 6 and SequenceMatcher(None, u, v).ratio() >= 0.86 for v in y - both) for u in x - both)


def greedy(records, entries, agenda):
    """Records of one block in turn, each taking what it likes best of what is left."""
    used, out = set(), {}
    for place, r in enumerate(records):
        free = [(k, e) for k, e in enumerate(entries) if e["id"] not in used]
        titles = {e["id"]: like(r["norm"], e["norm"]) for _, e in free}
        pick = None
        numbered = [e for _, e in free if agenda and e["item_no"] == r["item_no"]]
        if numbered:
            best = max(numbered, key=lambda e: titles[e["id"]])
            if titles[best["id"]] >= 0.5:
                pick = best["id"], round(titles[best["id"]], 3)
        if pick is None and free:
            k, best = max(free, key=lambda x: min(1.0, titles[x[1]["id"]] + (0.08 if x[0] == place else 0.0)))
            score = round(min(1.0, titles[best["id"]] + (0.08 if k == place else 0.0)), 3)
            both = shared(r["norm"], best["norm"])
            sure = not agenda or best["item_no"] == r["item_no"] or both >= 2 or (score >= 0.8 and both >= 1)
            if (score >= 0.55 and sure) or (agenda and score >= 0.5 and both >= 2) or (not agenda and k == place and score >= 0.5):
                pick = best["id"], score
        if pick:
            used.add(pick[0])
            out[r["id"]] = pick
    return out


def test_linkage_equals_choices_in_turn(spark, sides):
    blocks = [defaultdict(list), defaultdict(list)]
    for side, block in zip(sides, blocks, strict=True):
        for r in sorted(side, key=lambda r: (r["item_no"], r["id"])):
            if r["norm"]:
                block[r["week"], r["kind"]].append(r)
    expected = {}
    for key, records in blocks[0].items():
        expected |= greedy(records, blocks[1].get(key, []), key[1] == "agenda_item")
    got = {r.record_id: (r.entry_id, round(r.score, 9)) for r in queries.j7_linkage(spark, FOLDER).collect()}
    assert got == expected
    assert 3 * len(expected) >= len(sides[0])
    # Records do compete: some end with an entry that isn't their own.
    assert sum(entry != record + 1_000_000_000_000 for record, (entry, _) in expected.items()) > 100


def test_a_long_chain_of_equal_titles(spark):
    schema = "day string, kind string, id long, title string, item_no int"
    records = [("d", "urgent_motion", k, "Radweg Moserhofgasse umsetzen", 0) for k in range(12)]
    entries = [("d", "urgent_motion", 100 + k, "Radweg Moserhofgasse umsetzen", 0) for k in range(9)]
    got = link.link_one_to_one(spark.createDataFrame(records, schema), spark.createDataFrame(entries, schema), ["day", "kind"]).collect()
    assert {r.record_id: r.entry_id for r in got} == {k: 100 + k for k in range(9)}


def test_linkage_of_nothing(spark):
    empty = spark.createDataFrame([], "day string, kind string, id long, title string, item_no int")
    assert link.link_one_to_one(empty, empty, ["day", "kind"]).count() == 0
    assert link.similar_titles(empty, empty, ["day"]).count() == 0


def test_titles_without_a_ratio_make_no_index_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(link, "_gram_index", None)
    left = spark.createDataFrame([(1, "d", "Sanierung der Annenstraße"), (2, "d", "Kanal"), (3, "d", "Umbau Volksschule Nord")], "id long, day string, title string")
    right = spark.createDataFrame([(5, "d", "Betreff Sanierung der Annenstraße Bauteil 2"), (6, "d", "Kanal"), (2, "d", "Kanal"), (7, "d", "Volksschule Nord"), (8, "d", "Sanierung der Annenstrasse"), (9, "e", "Kanal")], "id long, day string, title string")
    got = sorted(tuple(r) for r in link.similar_titles(left, right, ["day"], fuzzy=False).collect())
    assert got == [(1, 5, 0.9), (2, 6, 1.0), (3, 7, 0.9)]
