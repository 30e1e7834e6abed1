"""Streams of several batches: what each adds, replays, restarts, rows without ids, views that fail."""

import json

import pytest
from pyspark.sql import functions as F

from quorumlake.streaming import incremental

SCHEMA = "record_id string, date string, kind string, status string, confidence double, title string"


def row(record_id, date, title, kind="agenda_item"):
    return {"record_id": record_id, "date": date, "kind": kind, "status": "accepted", "confidence": 0.5, "title": title}


@pytest.fixture
def table(spark, tmp_path):
    out = incremental.Versions(spark, str(tmp_path / "table"), spark.createDataFrame([], SCHEMA).schema)
    out.write(-1, spark.createDataFrame([("o1", "2024-01-01", "agenda_item", "accepted", 0.5, "alt"), ("", "2024-01-01", "agenda_item", "accepted", 0.5, "ohne")], SCHEMA))
    return out


def arrive(tmp_path, name, *rows):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def run(spark, tmp_path, table, **more):
    incremental.run_updates(spark, str(tmp_path / "in"), SCHEMA, table, str(tmp_path / "state"), ("record_id", "title"), str(tmp_path / "rejected"), files=1, **more).awaitTermination()


def titles(rows):
    return sorted(f"{r.record_id}|{r.title}" for r in rows.collect())


def test_batches_add_to_each_other(spark, tmp_path, table):
    arrive(tmp_path, "a.json", row("n1", "2024-02-01", "eins"), row("n1", "2024-02-01", "eins"), row("", "2024-02-01", "b1"), row("", "2024-02-01", "b2"), row("o2", "2024-01-01", "bekannter Tag"))
    arrive(tmp_path, "b.json", row("n2", "2024-02-01", "zwei"), row("n1", "2024-03-01", "schon da"), row("x", "2024-03-01", "falsch", "xx"), row(None, "2024-03-01", "ohne Feld"))
    run(spark, tmp_path, table)
    expected = ["o1|alt", "|ohne", "n1|eins", "|b1", "|b2", "n2|zwei"]
    n1 = [t for t in titles(table.all()) if t.startswith("n1|")]
    # Files come in any order; the first batch with an id gives its row.
    assert len(n1) == 1 and sorted(x for x in titles(table.all()) if not x.startswith("n1|")) == sorted(x for x in expected if not x.startswith("n1|"))
    assert table.numbers() == [-1, 0, 1]
    rejected = spark.read.parquet(str(tmp_path / "rejected"))
    assert sorted((r.title, len(r.errors)) for r in rejected.collect()) == [("falsch", 1), ("ohne Feld", 1)]
    # Nothing new: nothing changes. A further file goes on from the checkpoint.
    before = titles(table.all())
    run(spark, tmp_path, table)
    assert titles(table.all()) == before and table.numbers() == [-1, 0, 1]
    arrive(tmp_path, "c.json", row("n3", "2024-02-01", "drei"), row("n2", "2024-02-01", "nochmals"))
    run(spark, tmp_path, table)
    assert titles(table.all()) == sorted([*before, "n3|drei"]) and table.numbers() == [-1, 0, 1, 2]


def test_a_batch_played_again_changes_nothing(spark, tmp_path, table):
    batches = [spark.createDataFrame([("n1", "2024-02-01", "agenda_item", "accepted", 0.5, "eins"), ("", "2024-02-01", "agenda_item", "accepted", 0.5, "b")], SCHEMA), spark.createDataFrame([("n2", "2024-02-02", "agenda_item", "accepted", 0.5, "zwei")], SCHEMA)]
    step = lambda k: incremental.update_step(table, batches[k], k, ("record_id",), str(tmp_path / "rejected"))
    step(0)
    step(1)
    before = titles(table.all())
    step(1)
    step(0)
    assert titles(table.all()) == before == sorted(["o1|alt", "|ohne", "n1|eins", "|b", "n2|zwei"])


def test_a_part_that_is_not_whole_is_not_read(spark, tmp_path, table):
    (tmp_path / "table" / "part=0").mkdir()
    assert table.numbers() == [-1] and table.all().count() == 2


def test_of_an_id_always_the_same_row_is_added(spark, table):
    rows = [("n1", "2024-02-01", "agenda_item", "accepted", 0.5, f"t{k}") for k in range(20)]
    seen = {titles(incremental.additions(table.all(), spark.createDataFrame(rows, SCHEMA).repartition(n), ("record_id",))[0])[0] for n in (1, 3, 7)}
    assert len(seen) == 1


def test_views_in_the_order_of_their_needs(spark, tmp_path, table):
    made = []

    def view(name, needs=(), fails=False):
        def make(tables):
            made.append(name)
            rows = tables[needs[0]] if needs else tables["records"]
            return rows.select(F.lit(name).alias("by"), F.when(F.lit(fails), F.raise_error(F.lit("kaputt"))).otherwise(F.lit(1)).alias("n"))

        return incremental.View(name, make, needs)

    folder = str(tmp_path / "views")
    log = incremental.refreshed(table.all(), [view("c", ("b",)), view("b", ("a",)), view("a"), view("d", ("b", "a"))], folder, 0)
    assert [row[2] for row in log] == ["made"] * 4 and made.index("a") < made.index("b") < min(made.index("c"), made.index("d"))
    # b fails as it runs: what needs it is skipped and keeps its old part, a goes on.
    log = incremental.refreshed(table.all(), [view("c", ("b",)), view("b", ("a",), fails=True), view("a"), view("d", ("c", "a"))], folder, 1)
    assert {row[1]: row[2] for row in log} == {"a": "made", "b": "failed", "c": "skipped", "d": "skipped"}
    assert "kaputt" in next(row[3] for row in log if row[1] == "b")
    numbers = {name: incremental.Versions(spark, f"{folder}/{name}", spark.range(0).schema).numbers() for name in "abcd"}
    assert numbers == {"a": [0, 1], "b": [0], "c": [0], "d": [0]}


def test_views_follow_the_stream(spark, tmp_path, table):
    arrive(tmp_path, "a.json", row("n1", "2024-02-01", "eins"))
    arrive(tmp_path, "b.json", row("n2", "2024-02-01", "zwei"))
    views = [incremental.View("count", lambda t: t["records"].agg(F.count("*").alias("n"))), incremental.View("twice", lambda t: t["count"].select((F.col("n") * 2).alias("n")), ("count",))]
    run(spark, tmp_path, table, views=views, folder=str(tmp_path / "views"))
    states = incremental.Versions(spark, str(tmp_path / "views/twice"), spark.createDataFrame([], "n long").schema)
    assert [states.parts([k]).first().n for k in states.numbers()] == [6, 8]
    assert spark.read.parquet(str(tmp_path / "views/log")).where("outcome = 'made'").count() == 4
