"""Best-fit packing of tokenised documents by hierarchical residual packing.

Partitions tokenise their documents and pack the pieces best-fit (longest
first) on their own. Nearly full bins are final. All other bins go up a tree as
items of further best-fit rounds, eight partitions' or groups' at a time, up to
one root. What goes up is only how many bins there are of each fill, at most
CAPACITY counts a node, so that neither a task nor the root grows with the
corpus; a round packs counts instead of single bins. On the way down each
node's runs of bins learn where they ended, and the pieces join the runs of
their own partition.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lots, materialise

CAPACITY = 4096
END_ID = 1
#: A bin with no more room than this is final at once.
NEARLY_FULL = 16
FAN_IN = 8
#: Pieces that are packed together in a task.
LOCAL_PIECES = 200_000
#: Bytes of text that are tokenised together.
TOKENISED_BYTES = 8 << 20
#: Texts or groups of words that the tokenizer gets at once; of its output only the ids are held longer.
ENCODED = 64

#: Letters that stay one letter each in lower case and composed form.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_MARKS = r"!-&(-/:-@\[-`{-~"


class _Words:
    """Token ids of texts, of which every distinct word of a lot is tokenised once.

    A tokenizer that drops white space and joins nothing across it gives a
    text's ids as its words' ids in a row; whether it does is read from its own
    rules, and other tokenizers get whole texts. A plain word is a run of letters
    or marks, or one of letters and then one of marks, so that it has one or two
    parts, each closed by an id whose token ends a word.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [rules.get("pre_tokenizer") or {}]
        self.by_word = (
            any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and r"[^\s\p{L}\p{N}]+" in s["pattern"].get("Regex", "") for s in splits)
            and rules["model"].get("end_of_word_suffix") == "</w>"
            and not rules.get("post_processor")
        )
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for k in range(0, len(texts), ENCODED):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[k : k + ENCODED], add_special_tokens=False)]
        return out

    def _of_words(self, words: pa.Array) -> pa.ListArray:
        """Ids of each word."""
        two = pc.match_substring_regex(words, f"^[{_LETTERS}]+[{_MARKS}]+$")
        plain = pc.or_(two, pc.match_substring_regex(words, f"^([{_LETTERS}]+|[{_MARKS}]+)$"))
        plain, two = (np.asarray(x.to_numpy(zero_copy_only=False), bool) for x in (plain, two))
        at, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        joined = words.take(pa.array(at)).to_pylist()
        none = np.empty(0, np.uint32)
        flat = np.concatenate([none, *self.encode([" ".join(joined[k : k + 1000]) for k in range(0, len(joined), 1000)])])
        closed = np.flatnonzero(self.ends[flat]) + 1
        parts = np.cumsum(1 + two[at])
        if len(closed) == (parts[-1] if len(parts) else 0):
            sizes = np.diff(closed[parts - 1], prepend=0) if len(parts) else np.empty(0, np.int64)
        else:  # a rule that these patterns don't foresee
            each = self.encode(joined)
            sizes, flat = np.array([len(x) for x in each], np.int64), np.concatenate([none, *each])
        rest = self.encode(words.take(pa.array(odd)).to_pylist())
        sizes = np.concatenate([sizes, np.array([len(x) for x in rest], np.int64)])
        values = np.concatenate([flat, *rest])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))
        places = np.empty(len(words), np.int64)
        places[np.concatenate([at, odd])] = np.arange(len(words))
        return lists.take(pa.array(places))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each of texts, none of which is null."""
        if not self.by_word:
            return self.encode(texts.to_pylist())
        words = pc.ascii_split_whitespace(texts)
        found = words.flatten().dictionary_encode()
        ids = self._of_words(found.dictionary).take(found.indices)
        cuts = ids.offsets.to_numpy()[words.offsets.to_numpy() - words.offsets[0].as_py()]
        values = ids.values.to_numpy()
        return [values[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def long_ids(self, text: str) -> np.ndarray:
        """Ids of one text of any length, by stretches that end at white space."""
        if not self.by_word:
            return self.encode([text])[0]
        data, at, out = text.encode(), 0, []
        while at < len(data):
            end = at + TOKENISED_BYTES
            blank = data.find(b" ", end) if end < len(data) else -1
            end = len(data) if blank < 0 else blank
            out += self.ids(pa.array([data[at:end].decode()]))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint32)


_words: dict[str, _Words] = {}


def token_pieces(documents: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces.

    A document's ids end with END_ID; one longer than CAPACITY is cut into
    pieces of that length, the last maybe shorter. A null or empty text has
    END_ID alone. Repeated rows give repeated pieces, a null id stays null, and
    other columns play no part.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
        if path not in _words:
            _words[path] = _Words(path)
        words, end = _words[path], np.array([END_ID], "<u4")
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in lots(texts, TOKENISED_BYTES):
                lot = texts.slice(a, b - a)
                found = words.ids(lot) if b - a > 1 or len(lot[0].as_py()) <= TOKENISED_BYTES else [words.long_ids(lot[0].as_py())]
                out: list[tuple[int, int, int, int, int]] = []
                for row, ids in enumerate(found, a):
                    tokens = memoryview(np.append(ids, end).astype("<u4", copy=False)).cast("B")
                    for k, at in enumerate(range(0, len(tokens), 4 * CAPACITY)):
                        piece = tokens[at : at + 4 * CAPACITY]
                        out.append((row, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                rows, *columns = map(list, zip(*out, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, columns, kinds)], ["id", "piece", "start", "length", "ids_crc32"])

    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each item, longest first into the fullest bin that holds it; each bin's fill."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(CAPACITY + 1)]
    fills: list[int] = []
    rooms = 0  # bit r: there is a bin with room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fitting := rooms >> n:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = CAPACITY, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, fills


#: So many alike bins, whose items of each part are successive ones of a size: (size, first of them, offset).
Run = tuple[int, int, tuple[tuple[int, int, int], ...]]


def best_fit_counts(counts: dict[int, int]) -> list[Run]:
    """best_fit of counts[n] items of each size n, as runs (bins, fill, parts) of alike bins.

    Each step fills the bins of a run or uses up a size, so that the steps are
    bounded by the sizes and not by the items.
    """
    by_room: list[list[Run]] = [[] for _ in range(CAPACITY + 1)]
    rooms = 0
    full: list[Run] = []
    for n in sorted(counts, reverse=True):
        at, left = 0, counts[n]
        while left:
            if fitting := rooms >> n:
                room = n + (fitting & -fitting).bit_length() - 1
                bins, fill, parts = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, bins, fill, parts = CAPACITY, left, 0, ()
            # A bin that has taken one is the fullest that fits, so that it takes as many as it holds.
            each = room // n
            whole = min(bins, left // each)
            steps = [(whole, each)] if whole else []
            if whole < bins and (rest := left - whole * each):
                steps.append((1, rest))
            done = 0
            for number, held in steps:
                taken = [(size, i + done, o) for size, i, o in parts] + [(n, at + k * number, fill + k * n) for k in range(held)]
                run = (number, fill + held * n, tuple(taken))
                done, at, left = done + number, at + number * held, left - number * held
                if rest := CAPACITY - run[1]:
                    by_room[rest].append(run)
                    rooms |= 1 << rest
                else:
                    full.append(run)
            if parts and done < bins:
                by_room[room].append((bins - done, fill, tuple((size, i + done, o) for size, i, o in parts)))
                rooms |= 1 << room
    return full + [run for runs in by_room for run in runs]


def _local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces packed by LOCAL_PIECES, with their bin's fill, its rank among the partition's bins of that fill, and whether it goes up."""
    group = TaskContext.get().partitionId()
    ranked = np.zeros(CAPACITY + 1, np.int64)
    used, held, n = 0, [], 0

    def packed() -> pd.DataFrame:
        nonlocal used
        pieces = pd.concat(held, ignore_index=True)
        bins, offsets, fills = best_fit(pieces["length"].to_numpy())
        filled = np.array(fills)
        rank = pd.Series(filled).groupby(filled).cumcount().to_numpy() + ranked[filled]
        np.add.at(ranked, filled, 1)
        up = filled < CAPACITY - NEARLY_FULL
        out = pieces.assign(__bin=used + bins, __offset=offsets, __fill=filled[bins], __rank=rank[bins], __up=up[bins], __grp=group)
        used += len(fills)
        return out

    for frame in frames:
        if len(frame):
            held.append(frame)
            n += len(frame)
        if n >= LOCAL_PIECES:
            yield packed()
            held, n = [], 0
    if held:
        yield packed()


_PLAN = "grp long, child long, fill long, first long, n long, bin long, base long, into_fill long, into_rank long, up boolean"


def _merged(items: pd.DataFrame) -> pd.DataFrame:
    """A node's items (grp, child, fill, n), packed: ranges of a child's bins of a fill, by rank, and the node's bins that take them."""
    grp = int(items["grp"].iloc[0])
    by_fill = {int(f): part.sort_values("child") for f, part in items.groupby("fill")}
    bounds = {f: np.concatenate([[0], np.cumsum(part["n"].to_numpy())]) for f, part in by_fill.items()}
    children = {f: part["child"].tolist() for f, part in by_fill.items()}
    out, used, ranked = [], 0, {}
    for bins, fill, parts in best_fit_counts({f: int(b[-1]) for f, b in bounds.items()}):
        rank = ranked.get(fill, 0)
        ranked[fill] = rank + bins
        for size, first, offset in parts:
            b = bounds[size]
            for k in range(int(np.searchsorted(b, first, "right")) - 1, len(b) - 1):
                low, high = max(first, int(b[k])), min(first + bins, int(b[k + 1]))
                if low >= high:
                    break
                shift = low - first
                out.append((grp, children[size][k], size, low - int(b[k]), high - low, used + shift, offset, fill, rank + shift, fill < CAPACITY - NEARLY_FULL))
        used += bins
    return pd.DataFrame(out, columns=[f.split()[0] for f in _PLAN.split(", ")])


def _named(level: int, group: str, number: str) -> Column:
    """A sequence's number: 4 bits of its level, 24 of its node, 35 of its bin there."""
    return F.lit(level << 59) + F.shiftleft(F.col(group).cast("long"), 35) + F.col(number)


def _ended(plan: DataFrame, above: DataFrame | None, level: int) -> DataFrame:
    """(child, fill, first, n, sequence, at): where plan's ranges end, by what is known of the level above."""
    own = plan.select("up", "child", "fill", "first", "n", _named(level, "grp", "bin").alias("sequence"), F.col("base").alias("at"))
    if above is None:
        return own.drop("up")
    up = plan.where("up")
    higher = above.select(F.col("child").alias("grp"), F.col("fill").alias("into_fill"), F.col("first").alias("f2"), F.col("n").alias("n2"), "sequence", "at")
    low, high = F.greatest("into_rank", "f2"), F.least(F.col("into_rank") + F.col("n"), F.col("f2") + F.col("n2"))
    met = up.join(higher, ["grp", "into_fill"]).where(low < high)
    moved = met.select(
        "child", "fill", (F.col("first") + low - F.col("into_rank")).alias("first"), (high - low).alias("n"), (F.col("sequence") + low - F.col("f2")).alias("sequence"), (F.col("base") + F.col("at")).alias("at")
    )
    return moved.union(own.where("NOT up").drop("up"))


def pack(pieces: DataFrame) -> DataFrame:
    """pieces (with length from 1 to CAPACITY) plus sequence_id and offset.

    Offsets are gapless from 0 in each sequence. An empty table gives no rows;
    pieces of the same length go by their place in the table.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    local = materialise(pieces.mapInPandas(_local, f"{fields}, __bin long, __offset long, __fill long, __rank long, __up boolean, __grp long"), "op10-local")
    own = _named(0, "__grp", "__bin")
    first = local.where("__offset = 0").groupBy(F.col("__grp").alias("child"), F.col("__fill").alias("fill"), "__up").agg(F.count("*").alias("n"))
    items = materialise(first.where("__up").drop("__up"), "op10-counts")
    top = items.agg(F.max("child")).first()[0]
    if top is None:
        return local.select(*pieces.columns, own.alias("sequence_id"), F.col("__offset").alias("offset"))
    plans = []
    while not plans or top > 0:
        grouped = items.withColumn("grp", F.floor(F.col("child") / FAN_IN))
        plan = materialise(grouped.groupBy("grp").applyInPandas(_merged, _PLAN), "op10-plan")
        plans.append(plan)
        # A node's bins are counted at the item that lies at their start.
        items = plan.where("up AND base = 0").groupBy(F.col("grp").alias("child"), F.col("into_fill").alias("fill")).agg(F.sum("n").alias("n"))
        top //= FAN_IN
    ends = None
    for level in range(len(plans), 0, -1):
        ends = materialise(_ended(plans[level - 1], ends, level), "op10-ends")
    final = local.where("NOT __up").select(*pieces.columns, own.alias("sequence_id"), F.col("__offset").alias("offset"))
    ends = ends.select(*[F.col(c).alias(f"__to_{c}") for c in ends.columns])
    within = (F.col("__grp") == F.col("__to_child")) & (F.col("__fill") == F.col("__to_fill")) & (F.col("__rank") >= F.col("__to_first")) & (F.col("__rank") < F.col("__to_first") + F.col("__to_n"))
    moved = local.where("__up").join(ends, within)
    name = F.col("__to_sequence") + F.col("__rank") - F.col("__to_first")
    return final.union(moved.select(*pieces.columns, name.alias("sequence_id"), (F.col("__offset") + F.col("__to_at")).alias("offset")))


def pack_documents(documents: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and place.

    A document's ids end with END_ID; a null or empty text has that alone.
    Repeated rows are packed each, rows without an id too; texts are tokenised
    whole, however long. No rows give no rows. Other columns play no part.
    """
    return pack(materialise(token_pieces(documents, tokenizer_path, id_col, text_col), "op10-pieces")).withColumnRenamed("id", id_col)
