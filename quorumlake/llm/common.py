"""Shared folder, materialised tables and word splitting for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor must see.

    Where it is unset, a folder of this machine serves on a local master only.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths written within each keeping() that is under way, the innermost last.
_written: list[list[str]] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    It cuts the lineage, so that a lost executor costs no recomputation of what
    came before, and gives the optimiser true sizes for its join choices.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def keeping(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make()'s table, materialised; whatever else was materialised on the way is deleted then.

    What make() uses from outside stays. Nothing that stays reads what goes, so
    that a lost executor needs none of it.
    """
    _written.append([])
    try:
        out = materialise(make(), label)
    finally:
        *spent, kept = _written.pop() or [""]
    for path in spent:
        place = out.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(out.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
    if _written:
        _written[-1].append(kept)
    return out


def free_name(name: str, *frames: DataFrame) -> str:
    """A column name made from name that none of frames has."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_text(rows: DataFrame, text_col: str, kept: list[str]) -> tuple[DataFrame, int, int]:
    """kept's columns with the text as a string, its place, and how many of the columns are kept's.

    A string column that is kept anyway isn't sent twice.
    """
    columns = [F.col(f"`{c}`") for c in kept]
    if text_col in kept and dict(rows.dtypes)[text_col] == "string":
        return rows.select(*columns), kept.index(text_col), len(kept)
    return rows.select(*columns, F.col(text_col).cast("string").alias(free_name("text", rows))), len(kept), len(kept)


def lots(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most bytes together, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    start, size = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if size and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
    if len(sizes):
        yield start, len(sizes)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts in a row, and where each begins, with the end; a null is empty."""
    filled = pc.fill_null(texts, "")
    wide = isinstance(filled, (pa.LargeStringArray, pa.LargeBinaryArray))
    offsets = np.frombuffer(filled.buffers()[1], np.int64 if wide else np.int32)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes between words: [\x20\x09-\x0D]; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
