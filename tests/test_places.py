"""Street names in texts, subscriptions to works, walks with a budget: written cases and plain loops."""

import datetime
import random

from quorumlake.operators import answers, link
from quorumlake.plans import place_queries
from quorumlake.sources import html

FOLDER = "/root/testdata/sf0.001"


def names_in(spark, said, *known):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(said if isinstance(said, list) else [said])], "id int, text string")
    found = answers.street_names(texts, spark.createDataFrame([(n,) for n in known], "name string"))
    return sorted((r.name, r.first) for r in found.collect())


def test_false_suffixes_and_known_names_only(spark):
    assert names_in(spark, "Das ist vorweg zu prüfen. Die Beispielgasse ist betroffen.", "beispielgasse") == [("beispielgasse", 7)]
    assert names_in(spark, "Ausbau Murradweg und Radweg", "murradweg") == [("murradweg", 2)]


def test_names_of_several_words_and_spellings(spark):
    known = ("Algersdorfer  Strasse", "Am Rande des Großen Parks", "Hauptplatz", "Kaiser-Franz-Josef-Kai")
    assert names_in(spark, "In der „Algersdorfer Straße“, Am Rande des Großen Parks (Hauptplatz)!", *known) == [("algersdorfer straße", 3), ("am rande des großen parks", 5), ("hauptplatz", 10)]
    assert names_in(spark, "der Kaiser-Franz-Josef-Kai.", *known) == [("kaiser-franz-josef-kai", 2)]
    assert names_in(spark, "Algersdorfer", *known) == []


def test_lists_that_leave_out_the_first_word(spark):
    known = ("Waltendorfer Hauptstraße", "Schulgasse", "Ruckerlberggasse", "Waltendorfer Ruckerlberggasse")
    expected = [("ruckerlberggasse", 3), ("schulgasse", 3), ("waltendorfer hauptstraße", 3), ("waltendorfer ruckerlberggasse", 3)]
    for text in ("Bebauungsplan Waltendorfer Hauptstraße-Schulgasse-Ruckerlberggasse", "Bebauungsplan Waltendorfer Hauptstraße – Schulgasse - Ruckerlberggasse"):
        assert names_in(spark, text, *known) == expected


def test_no_names_in_nothing(spark):
    assert names_in(spark, [None, "", "  "], "Hauptplatz", None, "") == []


def test_subscriptions_equal_the_plain_loop(spark):
    rng = random.Random(2)
    day = lambda: rng.choice([None, datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(400))])
    words = ["Annenstraße", "Kai", "Gries", "Lend", "St", "Keplerstraße", "Bauarbeiten"]
    works = [(k, rng.choice([None, " ".join(rng.sample(words, 3))]), day(), day()) for k in range(150)]
    subs = [(k, rng.choice([None, "", "annenstraße", "KEPLER", "st", "niemals", " "]), rng.choice([None, "", "gries", "LEND", "ka"]), day(), day()) for k in range(120)]
    got = link.subscribed(spark.createDataFrame(works, "id int, text string, start_date date, end_date date"), spark.createDataFrame(subs, "sub int, street string, district string, start_date date, end_date date"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    expected = set()
    for s, street, district, a, z in subs:
        for w, text, b, e in works:
            said = (text or "").lower()
            if (street or "").lower() in said and (district or "").lower() in said and not (a and e and e < a) and not (z and b and b > z):
                expected.add((s, w))
    rows = got.collect()
    assert {(r.sub, r.id) for r in rows} == expected and len(rows) == len(expected) > 500


def test_budgeted_walk_equals_a_queue(spark):
    pages, links, start = place_queries.crawl_inputs(spark, FOLDER)
    stored = {r.url: r.readable for r in pages.collect()}
    out = {}
    for r in links.collect():
        out.setdefault(r.url, []).append((r.pos, r.target))
    for budget in (1, 3, 40, 150):
        queue, visited, depth = [(0, 0), (1, 0), (2, 0)], [], {0, 1, 2}
        while queue and len(visited) < budget:
            url, level = queue.pop(0)
            error = "not stored" if url not in stored else None if stored[url] else "not readable"
            visited.append((len(visited) + 1, url, level, error))
            for _, target in sorted(out.get(url, [])) if error is None else []:
                if target not in depth:
                    depth.add(target)
                    queue.append((target, level + 1))
        got = sorted(tuple(r) for r in html.crawl_within(pages, links, start, budget).collect())
        assert got == visited
    assert any(v[3] for v in visited)


def test_walk_from_nowhere(spark):
    pages = spark.createDataFrame([], "url string, readable boolean")
    links = spark.createDataFrame([], "url string, pos long, target string")
    assert html.crawl_within(pages, links, spark.createDataFrame([], "url string, pos long"), 40).count() == 0
    assert [(r.url, r.error) for r in html.crawl_within(pages, links, spark.createDataFrame([("a", 1)], "url string, pos long"), 40).collect()] == [("a", "not stored")]


def test_matched_pairs_are_not_dealt_out_again(spark):
    works = spark.createDataFrame([(1, "Annenstraße Kai", None, None)], "id int, text string, start_date date, end_date date")
    got = link.subscribed(works, spark.createDataFrame([(7, "annen", None, None, None), (8, None, "x", None, None)], "sub int, street string, district string, start_date date, end_date date"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan
    assert [tuple(r) for r in got.collect()] == [(7, 1)]
