"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's subwords are the 1- to 4-grams of its letters' code points within words
(with word edges), hashed to BUCKETS rows of an embedding table; their average
goes through a linear softmax. Table and softmax are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows. A temperature
and a rejection threshold are fitted on a part of the sample that training
doesn't see. As everything up to the softmax is linear, prediction sums one
score row per subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_text

BUCKET_BITS = 15
DIMENSIONS = 16
GRAMS = (1, 2, 3, 4)
#: Bound of the labelled sample: about so many rows per language, by a hash of id and text, and never more than SAMPLE_MOST in all.
SAMPLE_PER_LANGUAGE, SAMPLE_MOST = 400, 8000
EPOCHS, RATE, BATCH = 15, 4.0, 16
#: Words of the beginnings of sampled texts that thresholds are calibrated on beside whole texts.
BEGINNINGS = (1, 2, 6, 24)
#: Texts with fewer subwords than these have thresholds of their own.
LENGTHS = (16, 48, 160, 640)
#: Share of calibration texts, correctly labelled, that a threshold may reject; share of random texts that it has to reject if it may.
REJECTED_SHARE, RANDOM_SHARE = 0.001, 0.8
_SEED = 5
_STEP = 1 << 18
_P = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter; 0 for what is none."""
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x323B0):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters = table
    return _letters


def subwords(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords of the whole text, in parts of bounded size."""
    if not text:
        return
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letter_table()
    edge = np.zeros(1, np.uint32)
    for a in range(0, len(points), _STEP):
        low = max(0, a - 8)  # words that go over the cut keep their subwords but for a few counted twice
        x = np.concatenate([edge, table[points[low : a + _STEP]], edge])
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        x = x[keep]
        if not x.any():
            continue
        for n in GRAMS:
            m = len(x) - n + 1
            if m < 1:
                continue
            h = np.full(m, n * 0x51ED270B & 0xFFFFFFFF, np.uint32)
            inner = np.ones(m, bool)
            for k in range(n):
                part = x[k : k + m]
                h = (h ^ part) * _P[k]
                h ^= h >> np.uint32(15)
                if n == 1 or 0 < k < n - 1:
                    inner &= part != 0
            yield (h[inner] >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # bucket x language: embedding times weights
    bias: np.ndarray
    temperature: float
    thresholds: np.ndarray  # one for each range of LENGTHS

    def logits(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """Logits, None if the text has no letter, and how many subwords it has."""
        total, n = np.zeros(len(self.languages)), 0
        for part in subwords(text):
            counts = np.bincount(part, minlength=1 << BUCKET_BITS) if len(part) > 1 << BUCKET_BITS else None
            total += counts @ self.scores if counts is not None else self.scores[part].sum(axis=0)
            n += len(part)
        return (total / n + self.bias if n else None), n

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, accepted); und, 0 and False without letters."""
        z, n = self.logits(text) if self.languages else (None, 0)
        if z is None:
            return "und", 0.0, False
        p = _softmax(z[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.thresholds[np.searchsorted(LENGTHS, n, "right")])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _histogram(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's subwords and their counts."""
    parts = list(subwords(text))
    keys, times = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int32), np.empty(0, np.int64))
    return keys.astype(np.int32), times.astype(np.int32)


def _random_letters(text: str, seed: int) -> str:
    """The text with a random letter in the place of each of its letters."""
    dice = np.random.default_rng(seed)
    return "".join(chr(97 + k) if c.isalpha() else c for c, k in zip(text, dice.integers(0, 26, len(text)), strict=True))


#: Kinds of calibration texts.
WHOLE, BEGINNING, RANDOM = range(3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets and their counts of texts, of their beginnings, and of random letters of the same shape, so that the driver gets no texts."""
    for batch in batches:
        for key, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            said = text.as_py()
            # Only so much of the text is parted that the longest beginning is in it.
            words = said.split(None, max(BEGINNINGS))[: max(BEGINNINGS)]
            starts = [" ".join(words[:n]) for n in BEGINNINGS if n <= len(words)]
            found = [(WHOLE, said), *((BEGINNING, x) for x in starts), *((RANDOM, _random_letters(x, key % (1 << 32) + len(x))) for x in starts)]
            kinds, texts = zip(*found, strict=True)
            keys, times = zip(*map(_histogram, texts), strict=True)
            lists = pa.list_(pa.int32())
            columns = [pa.array([key] * len(found), pa.int64()), pa.array([lang] * len(found), pa.string()), pa.array(kinds, pa.int32()), pa.array(list(keys), lists), pa.array(list(times), lists)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lang", "kind", "keys", "times"])


def _views(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The values of each list, without a copy."""
    out = []
    for chunk in lists.chunks:
        ends, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        out += [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def _thresholds(p: np.ndarray, right: np.ndarray, kind: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each range of LENGTHS the probability from which a text is accepted.

    It rejects RANDOM_SHARE of the random texts of that length, unless that
    were more than REJECTED_SHARE of the real ones that are labelled rightly.
    """
    best, place = p.max(axis=1), np.searchsorted(LENGTHS, sizes, "right")
    out = np.zeros(len(LENGTHS) + 1)
    for k in range(len(out)):
        real, random = best[(place == k) & (kind != RANDOM) & right], best[(place == k) & (kind == RANDOM)]
        if len(real):
            out[k] = np.quantile(real, REJECTED_SHARE, method="lower")
            if len(random):
                out[k] = min(out[k], np.quantile(random, RANDOM_SHARE, method="higher") + 1e-9)
    return out


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows with text and language; only SAMPLE_* bound what is fitted on.

    Rows are taken by a hash of id (null as an empty one) and text, so reruns
    agree; of rows with the same id, text and language one teaches. Null and
    empty texts teach nothing. Without labelled rows the model knows no language
    and predicts und; of more than SAMPLE_MOST languages the most frequent are
    learnt. The driver holds the sampled rows' histograms: at most
    SAMPLE_MOST of them, with no more buckets than the table has.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id"))
    rows = rows.select("lang", "text", F.xxhash64(F.coalesce("id", F.lit("")), "text", F.lit(_SEED)).alias("key"))
    # No more languages than rows can be learnt, so that their counts are bounded too.
    sizes = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(SAMPLE_MOST))
    dice = F.pmod("key", F.lit(1 << 40)) / float(1 << 40)
    # Keys are chosen first, so that only the chosen rows' texts leave their scan; the choice is bounded, so it is broadcast.
    # A row's share is its place within its language, so that the limit takes as much from each.
    share = dice * F.col("n")
    chosen = rows.select("lang", "key").join(sizes, "lang").where(share < SAMPLE_PER_LANGUAGE).groupBy("lang", "key").agg(F.min(share).alias("share"))
    chosen = materialise(chosen.orderBy("share", "lang", "key").limit(SAMPLE_MOST).select("lang", "key"), "op2-sample")
    sample = rows.join(F.broadcast(chosen), ["lang", "key"]).groupBy("key", "lang").agg(F.min("text").alias("text"))
    got = sample.mapInArrow(_count, "key long, lang string, kind int, keys array<int>, times array<int>").toArrow()
    # The histograms stay where they arrived, only their order is made.
    order = pc.sort_indices(got.select(["lang", "key", "kind"]), sort_keys=[("lang", "ascending"), ("key", "ascending"), ("kind", "ascending")]).to_numpy()
    keys_all, times_all = (_views(got[name]) for name in ("keys", "times"))
    order = [i for i in order.tolist() if len(keys_all[i])]
    lang_all, key_all, kind_all = (got[name].to_pylist() for name in ("lang", "key", "kind"))
    texts_lang, text_key, kind = [lang_all[i] for i in order], [key_all[i] for i in order], np.array([kind_all[i] for i in order], int)
    keys, times = [keys_all[i] for i in order], [times_all[i] for i in order]
    languages = tuple(sorted(set(texts_lang)))
    if not languages:
        return Model((), np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), 1.0, np.zeros(len(LENGTHS) + 1))
    y_all = np.searchsorted(languages, texts_lang)
    sizes_all = np.array([int(t.sum()) for t in times])
    whole = np.flatnonzero(kind == WHOLE)
    y = y_all[whole]

    def shares(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a whole text and their shares of it."""
        return keys[whole[i]], times[whole[i]] / sizes_all[whole[i]]

    rng = np.random.default_rng(_SEED)
    held = rng.random(len(whole)) < 0.25
    if held.all() or not held.any():
        held = np.zeros(len(whole), bool)
    table = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    learn = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // BATCH)):
            docs = [shares(i) for i in part]
            means = np.array([share @ table[k] for k, share in docs])
            slope = _softmax(means @ weights + bias)
            slope[np.arange(len(part)), y[part]] -= 1
            slope /= len(part)
            back = slope @ weights.T
            weights -= rate * (means.T @ slope)
            bias -= 0.1 * rate * slope.sum(axis=0)
            for (k, share), g in zip(docs, back, strict=True):
                table[k] -= rate * share[:, None] * g
    scores = table @ weights
    check = np.flatnonzero(held) if held.any() else learn
    z = np.array([share @ scores[k] + bias for k, share in map(shares, check)])
    # Smoothed targets, as in Platt's scaling: a sample without errors gives no boundless confidence.
    slip = 1 / (len(check) + 2)
    goal = np.full(z.shape, slip / max(1, len(languages) - 1))
    goal[np.arange(len(check)), y[check]] = 1 - slip
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -(goal * np.log(np.maximum(_softmax(z / t), 1e-12))).sum(axis=1).mean())
    # Texts of held rows, their beginnings, and the random ones made of these.
    checked = {(texts_lang[whole[i]], k) for i, k in zip(check, [text_key[k] for k in whole[check]], strict=True)}
    rest = [i for i, key in enumerate(zip(texts_lang, text_key, strict=True)) if key in checked]
    p = _softmax(np.array([(times[i] / sizes_all[i]) @ scores[keys[i]] + bias for i in rest]) / temperature)
    thresholds = _thresholds(p, p.argmax(axis=1) == y_all[rest], kind[rest], sizes_all[rest])
    del got, keys, times, keys_all, times_all
    pa.default_memory_pool().release_unused()
    return Model(languages, scores.astype(np.float32), bias, float(temperature), thresholds)


def identify(documents: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """keep's columns (all, if None) with names: the language, its score and whether it is accepted; only the text decides.

    A text that is null, empty or has no letter is und with score 0 and not
    accepted. Texts are read whole, in parts of bounded size; equal texts and
    repeated rows get equal results. Columns of the input with one of names are
    replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets x languages
    kept = [c for c in (documents.columns if keep is None else keep) if c not in names]
    rows, at, n = with_text(documents, text_col, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column(at)]
            values = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *map(pa.array, values, (pa.string(), pa.float64(), pa.bool_()))], [*kept, *names])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in kept), *(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "boolean"), strict=True))])
    return rows.mapInArrow(run, out)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
