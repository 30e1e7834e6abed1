"""Importance resampling of documents towards a target distribution over hashed n-grams.

Features are runs of one to three words, dealt into buckets by their CRC-32.
The CRC of words in a row follows from the CRC of those before and the last
word alone, so that no feature's bytes are put together. A head vocabulary is
counted over all texts and broadcast: the frequent words with their exact CRC
states, and the frequent pairs of the most frequent words with their CRC and
bucket. What isn't in the head, the tail, gets its CRC directly; both feed the
same exact totals per bucket. The vocabulary has a fixed size and changes the
work only, never a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, lots, materialise, text_bytes

BUCKETS = 10_000
#: Words whose states are broadcast, and how many of them, the most frequent, form pairs.
HEAD_WORDS, PAIR_WORDS = 8192, 512
#: Pairs of these that are broadcast with their buckets.
HEAD_PAIRS = 65_536
#: A head word makes up at least one in so many of some lot's words.
SHARE = 65_536
#: Bytes of a head word at most; a longer word's features are summed up byte by byte.
WORD_BYTES = 62
#: Bytes of text that are held together.
LOT_BYTES = 8 << 20
LEAST_WORDS, DRAWN_PERCENT = 20, 5
#: What percentile_approx() may be off: a share of 1 / PRECISION of the rows.
PRECISION = 10_000

_FOLDED = np.zeros(256, np.uint8)
_FOLDED[48:58], _FOLDED[97:123], _FOLDED[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_FOLDED[65:91] = np.arange(97, 123)


def _shifts() -> np.ndarray:
    """What n further bytes of zero make of a CRC's byte, for each n up to WORD_BYTES + 1, place in the CRC and value."""
    out = np.zeros((WORD_BYTES + 2, 4, 256), np.uint32)
    for n in range(WORD_BYTES + 2):
        zeros = bytes(n)
        none = zlib.crc32(zeros)
        for k in range(4):
            # The tables are linear: eight single bits give all values of a byte.
            single = [zlib.crc32(zeros, 1 << (8 * k + bit)) ^ none for bit in range(8)]
            for bit, x in enumerate(single):
                out[n, k, 1 << bit : 2 << bit] = out[n, k, : 1 << bit] ^ np.uint32(x)
    return out.reshape(-1)


_tables: list[np.ndarray] = []


def shift_tables() -> np.ndarray:
    if not _tables:
        _tables.append(_shifts())
    return _tables[0]


def extended(crc: np.ndarray, spaced: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs of texts with the CRCs given and then a space and a word, whose own CRC is spaced and whose bytes, at most WORD_BYTES, are sizes."""
    table, base = shift_tables(), (sizes + 1) * 1024
    out = spaced ^ table[base + (crc & 255)]
    for k in (1, 2, 3):
        out ^= table[base + (256 * k + ((crc >> np.uint32(8 * k)) & 255))]
    return out


@dataclass
class Head:
    """The frequent words by number: their bytes, CRC, CRC after a space; and the frequent pairs."""

    words: pa.Array
    crc: np.ndarray
    spaced: np.ndarray
    pair_of: np.ndarray  # (PAIR_WORDS, PAIR_WORDS): the pair's number or -1
    pair_crc: np.ndarray
    pair_bucket: np.ndarray


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of texts in a row, and how many words come before each text's start, with the total."""
    folded = _FOLDED[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = folded != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1]
    begins[first] |= inside[first]
    starts = np.flatnonzero(begins)
    packed = folded[inside[:-1]]
    kept = np.cumsum(np.concatenate([[0], inside[:-1]]))
    offsets = np.append(kept[starts], len(packed)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return words, np.searchsorted(starts, bounds)


class _Lot:
    """The words of a lot of texts and the CRCs of all their features."""

    def __init__(self, texts: pa.Array, head: Head | None) -> None:
        data, bounds = text_bytes(texts)
        words, self.before = words_of(data, bounds)
        found = words.dictionary_encode()
        self.words, self.at = found.dictionary, found.indices.to_numpy()
        if head is None:
            return
        self.head_id = pc.fill_null(pc.index_in(self.words, head.words), -1).to_numpy().astype(np.int64)
        known = self.head_id >= 0
        crc, spaced = (np.empty(len(self.words), np.uint32) for _ in range(2))
        crc[known], spaced[known] = head.crc[self.head_id[known]], head.spaced[self.head_id[known]]
        tail, space = np.flatnonzero(~known), zlib.crc32(b" ")
        for k, word in zip(tail.tolist(), self.words.take(pa.array(tail)).to_pylist(), strict=True):
            crc[k], spaced[k] = zlib.crc32(word), zlib.crc32(word, space)
        self.crc, self.spaced, self.head = crc, spaced, head
        self.sizes = pc.binary_length(self.words).to_numpy().astype(np.int64)

    def _joined(self, crc: np.ndarray, last: np.ndarray) -> np.ndarray:
        """CRCs of features with one more word."""
        sizes = self.sizes[last]
        out = extended(crc, self.spaced[last], np.minimum(sizes, WORD_BYTES))
        for k in np.flatnonzero(sizes > WORD_BYTES).tolist():
            out[k] = zlib.crc32(b" " + self.words[int(last[k])].as_py(), int(crc[k]))
        return out

    def features(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Buckets of the features of one, two and three words, and where each text's begin."""
        at, head = self.at, self.head
        n = np.diff(self.before)
        last = np.zeros(len(at), np.int64)  # how many words follow in the text
        np.subtract(np.repeat(self.before[1:], n), np.arange(1, len(at) + 1), out=last)
        one = self.crc[at]
        two_at = np.flatnonzero(last >= 1)
        a, b = at[two_at], at[two_at + 1]
        ids = self.head_id[a], self.head_id[b]
        paired = (ids[0] >= 0) & (ids[1] >= 0) & (ids[0] < PAIR_WORDS) & (ids[1] < PAIR_WORDS)
        pair = np.full(len(two_at), -1, np.int64)
        pair[paired] = head.pair_of[ids[0][paired], ids[1][paired]]
        frequent = pair >= 0
        two = np.empty(len(two_at), np.uint32)
        two[frequent] = head.pair_crc[pair[frequent]]
        two[~frequent] = self._joined(one[two_at[~frequent]], b[~frequent])
        bucket = np.empty(len(two_at), np.int64)
        bucket[frequent] = head.pair_bucket[pair[frequent]]
        bucket[~frequent] = two[~frequent] % BUCKETS
        more = last[two_at] >= 2
        three = self._joined(two[more], at[two_at[more] + 2])
        less = [np.cumsum(np.concatenate([[0], np.maximum(n - k, 0)])) for k in range(3)]
        return [(one % BUCKETS).astype(np.int64), bucket, (three % BUCKETS).astype(np.int64)], less


def _texts(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.select(F.col(text_col).cast("string").alias("text"))


def head_words(texts: DataFrame, most: int = HEAD_WORDS) -> list[bytes]:
    """The most frequent words over all texts, ties by their bytes.

    Each lot is counted before rows are sent, and sends the words that make up
    1 / SHARE of it: a word that makes up as much of all texts does so in some lot.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in lots(batch.column(0), LOT_BYTES):
                lot = _Lot(batch.column(0).slice(a, b - a), None)
                n = np.bincount(lot.at, minlength=len(lot.words))
                frequent = pa.array((n * SHARE >= len(lot.at)) & (pc.binary_length(lot.words).to_numpy() <= WORD_BYTES))
                yield pa.RecordBatch.from_arrays([lot.words.filter(frequent).cast(pa.binary()), pa.array(n, pa.int64()).filter(frequent)], ["word", "n"])

    words = texts.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in words.orderBy(F.col("n").desc(), "word").limit(most).collect()]


def _head(words: list[bytes], pairs: list[tuple[int, int]]) -> Head:
    space = zlib.crc32(b" ")
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    pair_of = np.full((PAIR_WORDS, PAIR_WORDS), -1, np.int32)
    for k, (a, b) in enumerate(pairs):
        pair_of[a, b] = k
    pair_crc = np.array([zlib.crc32(b" " + words[b], int(crc[a])) for a, b in pairs], np.uint32)
    spaced = np.array([zlib.crc32(w, space) for w in words], np.uint32)
    return Head(pa.array(words, pa.large_binary()), crc, spaced, pair_of, pair_crc, (pair_crc % BUCKETS).astype(np.int64))


def head_vocabulary(texts: DataFrame, most: int = HEAD_WORDS, most_pairs: int = HEAD_PAIRS) -> Head:
    """The head vocabulary of all texts; of most words and most_pairs pairs at most, whatever the corpus."""
    words = head_words(texts, most)
    shared = texts.sparkSession.sparkContext.broadcast(_head(words, []))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIR_WORDS * PAIR_WORDS, np.int64)
        for batch in batches:
            for a, b in lots(batch.column(0), LOT_BYTES):
                lot = _Lot(batch.column(0).slice(a, b - a), None)
                ids = pc.fill_null(pc.index_in(lot.words, shared.value.words), -1).to_numpy().astype(np.int64)[lot.at]
                inner = np.ones(len(ids), bool)
                inner[lot.before[(lot.before > 0) & (lot.before < len(ids))]] = False
                left, right = ids[:-1], ids[1:]
                ok = (left >= 0) & (right >= 0) & (left < PAIR_WORDS) & (right < PAIR_WORDS) & inner[1:]
                total += np.bincount(left[ok] * PAIR_WORDS + right[ok], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["pair", "n"])

    pairs = texts.mapInArrow(counted, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    frequent = pairs.orderBy(F.col("n").desc(), "pair").limit(most_pairs).collect()
    return _head(words, [divmod(r.pair, PAIR_WORDS) for r in frequent])


def bucket_totals(texts: DataFrame, head) -> np.ndarray:
    """Features per bucket over all texts; a task sends one row per bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for a, b in lots(batch.column(0), LOT_BYTES):
                for buckets in _Lot(batch.column(0).slice(a, b - a), head.value).features()[0]:
                    total += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature in each bucket adds to a weight: thousandths of the log ratio of target to source, rounded down."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every document.

    Three passes over all texts: words, pairs of frequent words, bucket totals.
    A null or empty text has no features and weight 0; repeated rows stay and
    count each time. Without documents there are no rows; without a target text
    its totals are 0. Further columns play no part.
    """
    spark = documents.sparkSession
    source, wanted = _texts(documents, text_col), _texts(target, target_col)
    head = spark.sparkContext.broadcast(head_vocabulary(source))
    gain = spark.sparkContext.broadcast(gains(bucket_totals(source, head), bucket_totals(wanted, head)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in lots(batch.column(1), LOT_BYTES):
                part = batch.slice(a, b - a)
                lot = _Lot(part.column(1), head.value)
                weight, n_features = (np.zeros(len(part), np.int64) for _ in range(2))
                for buckets, starts in zip(*lot.features(), strict=True):
                    run = np.concatenate([[0], np.cumsum(gain.value[buckets])])
                    weight += run[starts[1:]] - run[starts[:-1]]
                    n_features += np.diff(starts)
                columns = [pa.array(x, pa.int64()) for x in (np.diff(lot.before), n_features, weight)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, score: str, least: int, id_col: str = "id", among: str = "eligible") -> DataFrame:
    """rows plus rank: 1 for the highest score of those among, ties to the smaller id and nulls last, up to least; null for all others.

    rows has to be stored, so that it doesn't change between jobs. A lower bound of
    the last rank's score parts the candidates from the rest; they are sorted by
    ranges, and each range's ranks start where those before it end.
    """
    none = F.lit(None).cast("long").alias("rank")
    n = rows.where(among).count()
    if not n or least <= 0:
        return rows.select("*", none)
    share = max(0.0, 1 - least / n - 2 / PRECISION)
    bound = rows.where(among).agg(F.percentile_approx(score, share, F.lit(PRECISION)).alias("at")).first().at
    chosen = F.col(among) & (F.col(score) >= bound)
    row, part = free_name("row", rows), free_name("part", rows)
    order = [F.col(score).desc(), F.col(id_col).asc_nulls_last(), F.col(row).asc()]
    numbered = rows.where(chosen).withColumn(row, F.monotonically_increasing_id())
    dealt = materialise(numbered.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "op12-candidates")
    sizes = sorted((r[part], r["count"]) for r in dealt.groupBy(part).count().collect())
    starts, before = [], 0
    for k, size in sizes:
        starts.append((k, before))
        before += size
    base = rows.sparkSession.createDataFrame(starts, f"`{part}` int, base long")
    placed = dealt.join(F.broadcast(base), part).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    drawn = placed.select(*rows.columns, F.when(F.col("rank") <= least, F.col("rank")).cast("long").alias("rank"))
    return drawn.union(rows.where(~F.coalesce(chosen, F.lit(False))).select("*", none))


def resampled(
    documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = 42
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document.

    score is the weight plus Gumbel noise made from a digest of seed and id (a
    null id counts as an empty one), so that the highest scores are a draw
    without replacement by the weights. Of the documents with least_words words
    percent of a hundred are drawn, rounded down; rank is null for all others.
    Repeated rows each have their rank, and so do rows with the same or no id.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    rows = weighed(documents, target, id_col, text_col, target_col).withColumn("score", F.col("weight") + noise).withColumn("eligible", F.col("n_words") >= least_words)
    stored = materialise(rows, "op12-weights")
    n = stored.where("eligible").count()
    return ranked(stored, "score", percent * n // 100).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
