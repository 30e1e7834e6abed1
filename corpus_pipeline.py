"""The corpus pipeline: language ID, near-duplicate removal, secret masking, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet into the shared folder and reads it for the next. All but the
last return the columns of documents, whatever further columns these have and
however they are named. An empty table stays empty through all stages; a null id,
text, language or source is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.llm import language, minhash, mixing, packing, secrets
from quorumlake.llm.common import free_name, keeping, materialise


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, trained on their labelled part, accepts.

    Texts that are null or have no letter go; repeated rows stand or fall together.
    """
    model = language.train(docs.where(~language.held_out()))
    names = tuple(free_name(n, docs) for n in ("lang_pred", "score", "accepted"))
    return language.identify(docs, model, names=names).where(F.col(names[2])).select(*docs.columns)


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, the first by id (nulls last), digest and text; rows without words all stay.

    Rows that merely share an id, or have none, are no duplicates of each other.
    """
    of_rows = materialise(minhash.components_of_rows(docs).where("node IS NOT NULL").select("component", "id", "node"), "pipeline-components")
    first = of_rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("at"))
    own, node, of, row = (free_name(n, docs) for n in ("own_id", "own_node", "of_node", "one_row"))
    kept = first.select(F.col("at.id").alias(own), F.col("at.node").alias(node))
    rows = minhash.with_node(docs, node_col=of)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(of) == F.col(node))
    chosen = rows.join(kept, same, "left_semi")
    # Copies that share the id and the set of a kept row: the first by text and the other columns as JSON stays, as not all types have an order.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    one = chosen.groupBy("doc_id", of).agg(F.min_by(F.struct("text", *others), F.struct("text", F.to_json(F.struct(*others)) if others else F.lit(""))).alias(row))
    one = one.select(*(F.col("doc_id") if c == "doc_id" else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns))
    return one.union(rows.where(F.col(of).isNull()).select(*docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [secret] in the place of every secret, and their new length in n_chars if there is such a column."""
    found = free_name("found", docs)
    scanned = secrets.scan_secrets(docs, found_col=found)
    hit = F.size(found) > 0
    scanned = scanned.withColumn("text", F.when(hit, secrets.masked(F.coalesce("text", F.lit("")), F.col(found))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        scanned = scanned.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return scanned.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them: not at all, or up to three times."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", keep_one_per_group),
    ("secret scans", mask_secrets),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: The first stage's classifier has no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def after(k: int) -> DataFrame:
        """What k stages leave; what they wrote on the way, the result before included, is deleted once it is written."""
        if k == 0:
            return spark.read.parquet(f"{sf_dir}/documents.parquet")
        name, stage = STAGES[k - 1]
        return keeping(lambda: stage(spark, after(k - 1), sf_dir), "pipeline-" + name.replace(" ", "-"))

    return STAGES[-1][1](spark, after(len(STAGES) - 1), sf_dir)
