"""Removal of repeated byte strings by suffix arrays over the whole corpus.

A string of LENGTH bytes that starts at two places makes every byte under both
of them go. All starts of such strings meet as follows.

1. Every window of LENGTH bytes has an anchor: the least hash among its GRAM-byte
   strings, the leftmost of equals. Successive windows with the same anchor place
   form a run. Equal windows have equal anchors, so equal strings only lie in
   runs with one anchor.
2. An anchor with one run has no other windows to meet; where all of an anchor's
   runs are equal, they are repeated whole. Of the other anchors' runs each
   distinct one is kept once, with its count.
3. Anchors with more distinct runs than a shard holds (the edges of a passage that
   many texts share) are dealt on. Equal windows have their anchor at the same
   place, so a run is cut into pieces by blocks of places, and a piece goes to the
   group of its block and of the bytes that all windows of the block cover. Groups
   of one piece go, groups of equal pieces are repeated whole, and groups that are
   still too large are dealt on by narrower blocks, down to single windows.
4. A task joins the stretches of some groups, sorts the suffixes by grouping and
   takes the windows that share LENGTH bytes with a neighbour in that order.
5. Spans are merged per text and cut out. Texts are known by their SHA-256, so
   copies share the work and the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeping, materialise
from .grouping import suffix_array

LENGTH, GRAM = 200, 32
_W = LENGTH - GRAM + 1
_BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = np.uint64((1 << 20) - 1)
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _powers:
        n = _BLOCK + LENGTH + 1
        for base in (_BASE, _INVERSE):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
        _powers.append(np.random.default_rng(21).integers(1, 2**63, 256, dtype=np.uint64))
    return _powers


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * salt)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(data: bytes, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, content hash, first window, windows) of each run of data's windows."""
    powers, inverses, letters = _tables()
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(data) - LENGTH + 1, _BLOCK):
        x = letters[np.frombuffer(data, np.uint8, min(_BLOCK + LENGTH - 1, len(data) - a), a)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers[: len(x)], dtype=np.uint64)])
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * inverses[: len(x) - GRAM + 1], salt)
        keys = (grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64)
        fill = -len(keys) % _W
        grid = np.concatenate([keys, np.full(fill, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, _W)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(x) - LENGTH + 1
        at = (np.minimum(behind[:windows], ahead[_W - 1 : _W - 1 + windows]) & _MASK).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], windows)
        content = _mixed((sums[last + LENGTH - 1] - sums[first]) * inverses[first] + (last - first).astype(np.uint64))
        found.append((grams[at[first]].view(np.int64), content.view(np.int64), first + a, last - first))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: Bytes whose suffixes are sorted together.
SHARD_BYTES = 1 << 17
#: Distinct runs of a group that surely fit a shard; a group with more is dealt on.
MANY_RUNS = SHARD_BYTES // (LENGTH + _W - 1)
#: Places of the anchor in a block, by round.
WIDTHS = (64, 16, 4, 1)


def _text_key(text):
    """The first 16 bytes of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32))


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], []]
        keys: list[bytes] = []
        times: list[int] = []
        for text in batch.column(0):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            found = runs(data)
            keys.append(hashlib.sha256(data).digest()[:16])
            times.append(len(found[0]))
            for column, value in zip(out, found, strict=True):
                column.append(value)
        a, e, first, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
        t = pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), times)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(e), t, pa.array(first.astype(np.int64)), pa.array(n.astype(np.int64))], ["a", "e", "t", "first", "n"])


def _emit_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text and its wanted runs -> one row per run with its bytes."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            for w in wanted.as_py():
                row = (w["a"], w["e"], w["c"], w["d"], data[w["first"] : w["first"] + w["n"] + LENGTH - 1])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(list(map(pa.array, out, kinds)), ["a", "e", "c", "d", "bytes"])


def _window_hashes(data: bytes) -> np.ndarray:
    powers, inverses, letters = _tables()
    out = []
    for a in range(0, len(data) - LENGTH + 1, _BLOCK):
        x = letters[np.frombuffer(data, np.uint8, min(_BLOCK + LENGTH - 1, len(data) - a), a)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers[: len(x)], dtype=np.uint64)])
        out.append(_mixed((sums[LENGTH:] - sums[:-LENGTH]) * inverses[: len(x) - LENGTH + 1]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _anchor_places(stretches: list[bytes]) -> np.ndarray:
    """Where the anchor of each stretch's first window begins."""
    powers, inverses, letters = _tables()
    x = letters[np.frombuffer(b"".join(d[:LENGTH] for d in stretches), np.uint8).reshape(-1, LENGTH)] * powers[:LENGTH]
    sums = np.concatenate([np.zeros((len(x), 1), np.uint64), np.cumsum(x, axis=1, dtype=np.uint64)], axis=1)
    grams = _mixed((sums[:, GRAM:] - sums[:, :-GRAM]) * inverses[:_W])
    return ((grams & ~_MASK) | np.arange(_W, dtype=np.uint64)).argmin(axis=1)


def pieces(data: bytes, place: int, width: int) -> list[tuple[int, int, bytes, bytes]]:
    """(block, first window, core, bytes) of each piece of a run whose anchor begins at place; the core lies in every window of the block."""
    n = len(data) - LENGTH + 1
    out = []
    for block in range((place - n + 1) // width, place // width + 1):
        low, high = block * width, block * width + width - 1
        first, last = max(0, place - high), min(n - 1, place - low)
        out.append((block, first, data[place - low : place - high + LENGTH], data[first : last + LENGTH]))
    return out


def _deal_on(width: int):
    """Runs or pieces by group k -> narrower pieces by narrower groups, with a digest g of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                rows = [c.to_pylist() for c in batch.slice(at, 2048).columns]
                out: list[list] = [[], [], [], [], [], []]
                for k, a, e, low, data, place in zip(*rows, _anchor_places(rows[4]).tolist(), strict=True):
                    for block, first, core, piece in pieces(data, place, width):
                        key = xxhash.xxh3_64_intdigest(core, (k ^ block) & (1 << 64) - 1)
                        row = (key - (1 << 64) if key >> 63 else key, a, e, low + first, piece, xxhash.xxh3_128_digest(piece))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(list(map(pa.array, out, kinds)), ["k", "a", "e", "low", "bytes", "g"])

    return run


def _dealt(many: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Pieces (k, a, e, c, low, bytes) of runs (k, a, e, low, bytes) by groups that fit a shard, and places (a, e, s, x) of those repeated whole."""
    parts, whole = [], []
    for width in WIDTHS:
        if many.isEmpty():
            break
        dealt = materialise(many.mapInArrow(_deal_on(width), "k long, a long, e long, low long, bytes binary, g binary"), "op6-dealt")
        groups = dealt.groupBy("k", "g").agg(F.count("*").alias("c")).groupBy("k").agg(F.count("*").alias("d"), F.sum("c").alias("c")).where("c > 1").drop("c")
        met = materialise(dealt.join(materialise(groups, "op6-groups"), "k"), "op6-met-pieces")
        whole.append(met.where("d = 1").select("a", "e", F.col("low").alias("s"), (F.col("low") + F.length("bytes")).alias("x")))
        small = f"d <= {MANY_RUNS}" if width > 1 else "true"  # a group of single windows has one, whatever its size
        parts.append(met.where(f"d > 1 AND {small}").select("k", "a", "e", F.lit(1).cast("long").alias("c"), "low", "bytes"))
        many = met.where(f"d > 1 AND NOT ({small})").select("k", "a", "e", "low", "bytes")
    return parts, whole


def repeated_windows(parts: list[bytes], counts: list[int]) -> list[list[tuple[int, int]]]:
    """For each of parts, the spans of its bytes under windows that occur elsewhere in parts, or in the part's own copies.

    Parts none of whose windows can have an equal, by their hashes, are not
    joined. The suffixes of the others, joined, are sorted by grouping; windows
    are equal when their suffixes are neighbours with LENGTH bytes in common.
    """
    hashes = [_window_hashes(p) for p in parts]
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    marked = times[inverse] > 1
    bounds = np.cumsum([0] + [len(h) for h in hashes])
    hulls: dict[bytes, list[tuple[int, int]]] = {}
    spans: list[list[tuple[int, int]]] = [[] for _ in parts]
    for k, part in enumerate(parts):
        if counts[k] > 1:
            spans[k].append((0, len(part)))
        inside = np.flatnonzero(marked[bounds[k] : bounds[k + 1]])
        if len(inside):
            low, high = int(inside[0]), int(inside[-1]) + LENGTH
            hulls.setdefault(part[low:high], []).append((k, low))
    order = list(hulls)
    joined = b"".join(order)
    begins = np.cumsum([0] + [len(x) for x in order])
    whole = np.zeros(len(joined) + 1, bool)  # starts of windows that lie inside one part
    for begin, x in zip(begins, order, strict=False):
        whole[begin : begin + len(x) - LENGTH + 1] = True
    twice = np.zeros(len(joined) + 1, bool)
    before = -1
    for start in suffix_array(joined):
        if whole[start]:
            if before >= 0 and joined[start : start + LENGTH] == joined[before : before + LENGTH]:
                twice[start] = twice[before] = True
            before = start
    for begin, x in zip(begins, order, strict=False):
        places = hulls[x]
        found = [(0, len(x))] if len(places) > 1 else _covered(np.flatnonzero(twice[begin : begin + len(x)]))
        for k, low in places:
            spans[k] += [(low + s, low + e) for s, e in found]
    return spans


def _covered(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans under windows that begin at starts (ascending)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return [(int(x[0]), int(x[-1]) + LENGTH) for x in np.split(starts, cut)]


def _sort_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come ordered by group; whole groups are gathered up to SHARD_BYTES."""
    held: list[tuple[int, bytes, int, bytes]] = []  # group, digest, copies, bytes
    size, last = 0, None

    def solved() -> pd.DataFrame:
        out = []
        for (k, g, _, _), spans in zip(held, repeated_windows([x[3] for x in held], [x[2] for x in held]), strict=True):
            out += [(k, g, s, e) for s, e in spans]
        return pd.DataFrame(out, columns=["k", "g", "low", "high"]).astype({"k": "int64", "low": "int64", "high": "int64"})

    for frame in frames:
        for k, g, c, data in zip(frame["k"], frame["g"], frame["c"], frame["bytes"], strict=True):
            if size >= SHARD_BYTES and k != last:
                yield solved()
                held, size = [], 0
            held.append((k, bytes(g), c, bytes(data)))
            size, last = size + len(data), k
    if held:
        yield solved()


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            at = removed = number = 0
            kept = hashlib.sha256()
            end = -1
            for s, e in sorted((x["low"], x["high"]) for x in spans.as_py() or ()):
                if s > end:
                    number += 1
                    kept.update(data[max(at, 0) : s])
                    removed += e - s
                    end = at = e
                elif e > end:
                    removed += e - end
                    end = at = e
            kept.update(data[at:])
            for column, value in zip(out, (len(data), removed, number, kept.hexdigest()), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(t, spans) of every text (column text, key t) with repeated bytes; spans may overlap."""
    found = materialise(texts.select("text").mapInArrow(_emit_runs, "a long, e long, t binary, first long, n long"), "op6-runs")
    anchors = found.groupBy("a").agg(F.min("e").alias("low_e"), F.max("e").alias("high_e"), F.count("*").alias("c")).where("c > 1").select("a", (F.col("low_e") == F.col("high_e")).alias("alike"))
    met = materialise(found.join(materialise(anchors, "op6-anchors"), "a"), "op6-met")
    end = (F.col("first") + F.col("n") + LENGTH - 1).alias("high")
    whole = met.where("alike").select("t", F.col("first").alias("low"), end)

    unlike = met.where("NOT alike")
    distinct = materialise(unlike.groupBy("a", "e").agg(F.count("*").alias("c"), F.min(F.struct("t", "first", "n")).alias("at")), "op6-distinct")
    many = materialise(distinct.groupBy("a").agg(F.count("*").alias("d")).where(f"d > {MANY_RUNS}"), "op6-many")
    wanted = distinct.join(many, "a", "left").select("at.t", F.struct("a", "e", "c", F.coalesce("d", F.lit(0)).alias("d"), "at.first", "at.n").alias("w")).groupBy("t").agg(F.collect_list("w").alias("wanted"))
    sources = texts.select("t", "text").dropDuplicates(["t"]).join(materialise(wanted, "op6-wanted"), "t").select("text", "wanted")
    stretches = materialise(sources.mapInArrow(_emit_stretches, "a long, e long, c long, d long, bytes binary"), "op6-stretches")

    few = stretches.where("d = 0").select(F.col("a").alias("k"), "a", "e", "c", F.lit(0).cast("long").alias("low"), "bytes")
    dealt, alike = _dealt(stretches.where("d > 0").select(F.col("a").alias("k"), "a", "e", F.lit(0).cast("long").alias("low"), "bytes"))
    parts = reduce(DataFrame.union, dealt, few)
    parts = materialise(parts.withColumn("g", F.unhex(F.substring(F.sha2("bytes", 256), 1, 32))), "op6-parts")
    shards = parts.groupBy("k", "g").agg(F.sum("c").alias("c"), F.first("bytes").alias("bytes"))
    shards = shards.repartition("k").sortWithinPartitions("k", "g").select("k", "g", "c", "bytes")
    solved = materialise(shards.mapInPandas(_sort_shards, "k long, g binary, low long, high long"), "op6-solved")
    inside = solved.select("k", "g", F.col("low").alias("from"), F.col("high").alias("to"))
    of_parts = parts.join(inside, ["k", "g"]).select("a", "e", (F.col("low") + F.col("from")).alias("s"), (F.col("low") + F.col("to")).alias("x"))
    of_runs = materialise(reduce(DataFrame.union, alike, of_parts), "op6-of-runs")
    partial = unlike.join(of_runs, ["a", "e"]).select("t", (F.col("first") + F.col("s")).alias("low"), (F.col("first") + F.col("x")).alias("high"))
    copied = materialise(distinct.where("c > 1").join(many, "a", "left_semi").select("a", "e"), "op6-copied")  # dealing looks at each distinct run once
    spans = whole.union(partial).union(unlike.join(copied, ["a", "e"]).select("t", F.col("first").alias("low"), end)).distinct()
    return spans.groupBy("t").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256), one row per input row.

    A null text is empty; a text of fewer than LENGTH bytes keeps all. Repeated
    rows and copies, of any number, lose all that their LENGTH-byte strings cover.
    No rows give no rows. Other columns play no part, whatever their names.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = docs.withColumn("t", _text_key(F.col("text")))
    spans = keeping(lambda: repeated_spans(keyed), "op6-spans")
    kind = docs.schema["id"].dataType.simpleString()
    joined = keyed.join(spans, "t", "left").select("id", "text", "spans")
    return joined.mapInArrow(_cut_out, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
