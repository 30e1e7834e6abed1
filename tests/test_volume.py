"""What queries shuffle, by the bytes of their input: rows that nobody asks for stay where they are read."""

import os

import pytest

from quorumlake.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def shuffled(spark, query):
    """Bytes that a query's stages write for shuffles."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    store = sc._jsc.sc().statusStore()

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(s.shuffleWriteBytes() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))

    before = total()
    # As with large tables: they are not sent to all tasks unless the query asks for it.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        query(spark, FOLDER).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return total() - before


@pytest.mark.parametrize(("name", "tables", "most"), [("search_documents", ["documents"], 12.0), ("q11_question_scores", ["documents"], 1.0), ("q6_phrase_matches", ["orders", "customer", "part"], 3.0)])
def test_shuffles_by_input(spark, name, tables, most):
    read = sum(os.path.getsize(f"{FOLDER}/{t}.parquet") for t in tables)
    got = shuffled(spark, QUERIES[name])
    assert got <= most * read, (name, got / read)
