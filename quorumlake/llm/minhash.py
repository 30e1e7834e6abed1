"""Near-duplicate components by b-bit MinHash.

Words are split at [\\x20\\x09-\\x0D] after lower-casing A-Z; a text's set holds its
distinct five-word shingles (all its words as one shingle where there are fewer).

1. Each text gets a digest of its whole set, PERMUTATIONS minima, one key per
   band of ROWS minima, and the two low bits of every (mixed) minimum packed into
   four longs. Texts with equal digests become one node.
2. In each band bucket the nodes are compared with two pivots only, never all
   with all. Bit counts of the packed signatures give a similarity corrected for
   chance collisions; pairs well below the threshold go, the others are
   confirmed on the full sets.
3. Components are labelled; in buckets that still span several components, the nodes
   outside the largest one are compared with all others, so that no link is lost
   however the pivots fell. Both are dealt into blocks of bounded size for this:
   a row is a block of nodes outside and one of all, its task compares signatures
   and then full sets, and only links that join two components come out, not the pairs.

With four rows and 32 bands a pair at similarity 0.75 shares a bucket with
probability 1 - (1 - 0.75^4)^32 > 0.99999; the signature estimate has a standard
deviation of 0.05, and the cut lies five of them below the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeping, materialise, with_text

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 75
ROWS, BANDS = 4, 32
PERMUTATIONS = ROWS * BANDS
ESTIMATE_CUT = 0.5
_BLOCK = 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POSITION, _SCALE, _SHIFT, _BAND = _odd(11, SHINGLE_WORDS), _odd(12, PERMUTATIONS), _odd(13, PERMUTATIONS), _odd(14, ROWS)
_BAND_SALT = _odd(15, BANDS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    s = np.full(n, min(len(words), SHINGLE_WORDS), np.uint64)
    for k in range(min(len(words), SHINGLE_WORDS)):
        s += h[k : k + n] * _POSITION[k]
    return np.unique(_mixed(s))


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), _BLOCK):
        x = hashes[a : a + _BLOCK, None] * _SCALE
        x += _SHIFT
        np.minimum(least, x.min(axis=0), out=least)
    bands = _mixed((least.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + _BAND_SALT)
    low = (_mixed(least) >> np.uint64(40)) & np.uint64(3)
    shifts = np.arange(32, dtype=np.uint64) * np.uint64(2)
    packed = np.bitwise_or.reduce(low.reshape(4, 32) << shifts, axis=1)
    return bands.view(np.int64), packed.view(np.int64)


_FEATURES = "id long, n_shingles long, node binary, bands array<bigint>, bits array<bigint>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a in range(0, len(ids), 512):
            out: list[list] = [[], [], [], []]
            for text in texts.slice(a, 512):
                h = shingles(text.as_py())
                bands, bits = _signature(h) if len(h) else (None, None)
                for column, value in zip(out, (len(h), digest(h) if len(h) else None, bands, bits), strict=True):
                    column.append(value)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, 512), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], lists), pa.array(out[3], lists)],
                ["id", "n_shingles", "node", "bands", "bits"],
            )


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold; a text that isn't its node's own (a repeated id) is passed over."""
    recent: dict[bytes, np.ndarray] = {}

    def of(node: bytes, text: str) -> np.ndarray | None:
        if node not in recent:
            h = shingles(text)
            if digest(h) != node:
                return None
            if len(recent) >= 64:
                recent.pop(next(iter(recent)))
            recent[node] = h
        return recent[node]

    for batch in batches:
        left, right = [], []
        for a, text_a, b, text_b in zip(*(batch.column(k) for k in range(4)), strict=True):
            x, y = of(a.as_py(), text_a.as_py()), of(b.as_py(), text_b.as_py())
            if x is None or y is None:
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= THRESHOLD_PERCENT * (len(x) + len(y) - both):
                left.append(a.as_py())
                right.append(b.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def similarity_estimate(x: str, y: str):
    """Similarity of two packed signatures, corrected for the quarter of minima that agree by chance."""
    differ = F.lit(0)
    for k in range(4):
        unlike = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        differ += F.bit_count(unlike.bitwiseOR(F.shiftright(unlike, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return ((PERMUTATIONS - differ) / PERMUTATIONS - 0.25) / 0.75


def _links(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, label: str) -> DataFrame:
    """Of distinct candidate pairs (a, b), those confirmed on full sets."""
    bits = nodes.select("node", "bits")
    near = (
        pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a")
        .join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b")
        .where(similarity_estimate("bits_a", "bits_b") >= ESTIMATE_CUT)
        .select("a", "b")
    )
    near = materialise(near, f"{label}-near")
    owner = nodes.select("node", F.col("id").alias("owner"))
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(owner, "node")
    texts = materialise(documents.join(wanted, F.col("id").eqNullSafe(F.col("owner"))).select("node", "text"), f"{label}-texts")
    full = (
        near.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "text_a", "b", "text_b")
    )
    return full.mapInArrow(_confirmed, "a binary, b binary").distinct()


#: Nodes of a bucket that are compared in one task with as many others, and about how many bytes of shingles these may have.
BLOCK_NODES, BLOCK_BYTES = 512, 8 << 20
#: Blocks of all nodes that go to one key with a block of those outside.
FACED = 16
_FULL_BITS = 1 << 16


def _side(nodes: pa.StructArray) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """node, component, bands, bits and the node as two numbers in its order, of a block's nodes."""
    node, component, bands, bits = nodes.flatten()
    order = np.frombuffer(b"".join(node.to_pylist()), ">u8").reshape(-1, 2)
    return node, component, *(x.flatten().to_numpy().reshape(len(nodes), -1) for x in (bands, bits)), order


def _near_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks, the left one of nodes outside, the nodes involved and, as places among them, the pairs to confirm.

    A pair of nodes counts in the first band that both share, and once if both lie outside.
    """
    for batch in batches:
        band, at_x, at_y, mains = (batch.column(k) for k in range(4))
        for r in range(batch.num_rows):
            (node_x, part_x, bands_x, x, order_x), (node_y, part_y, bands_y, y, order_y) = (_side(batch.column(k)[r].values) for k in (4, 5))
            x, y = x.view(np.uint64), y.view(np.uint64)
            differ = np.zeros((len(x), len(y)), np.int16)
            for k in range(x.shape[1]):
                unlike = x[:, None, k] ^ y[None, :, k]
                differ += np.bitwise_count((unlike | (unlike >> np.uint64(1))) & np.uint64(0x5555555555555555))
            named = pa.concat_arrays([part_x, part_y, pa.array([mains[r].as_py()], part_x.type)]).dictionary_encode().indices.to_numpy()
            p, q, main = named[: len(x)], named[len(x) : -1], named[-1]
            near = (((PERMUTATIONS - differ) / PERMUTATIONS - 0.25) / 0.75 >= ESTIMATE_CUT) & (p[:, None] != q[None, :])
            i, j = np.nonzero(near)
            (a, b), (c, d) = order_x[i].T, order_y[j].T
            once = (q[j] == main) | (a < c) | ((a == c) & (b < d))
            i, j = i[once], j[once]
            if len(i):
                first = np.full(len(i), -1)
                for k in range(BANDS - 1, -1, -1):
                    first[bands_x[i, k] == bands_y[j, k]] = k
                here = bands_x[i, first] == band[r].as_py()
                i, j = i[here], j[here]
            if len(i):
                ui, uj = np.unique(i), np.unique(j)
                nodes = pa.concat_arrays([node_x.take(pa.array(ui)), node_y.take(pa.array(uj))]).to_pylist()
                flat = np.stack([np.searchsorted(ui, i), len(ui) + np.searchsorted(uj, j)], axis=1).ravel().astype(np.int32)
                columns = [*(v.slice(r, 1) for v in (band, at_x, at_y)), pa.array([nodes], pa.list_(pa.binary())), pa.array([flat], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["band", "x", "y", "nodes", "pairs"])


def _joined_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block pair's candidates, links confirmed on full sets that join nodes not yet joined here."""
    for batch in batches:
        left: list[bytes] = []
        right: list[bytes] = []
        for row in (x for r in range(batch.num_rows) for x in batch.slice(r, 1).to_pylist()):
            sets: dict[bytes, np.ndarray] = {}
            for t in row["texts"]:
                if t["node"] not in sets and digest(h := shingles(t["text"])) == t["node"]:
                    sets[t["node"]] = h
            nodes, pairs = row["nodes"], np.array(row["pairs"]).reshape(-1, 2)
            group = list(range(len(nodes)))

            def find(k: int, group: list[int] = group) -> int:
                while group[k] != k:
                    group[k] = group[group[k]]
                    k = group[k]
                return k

            words = np.unique(np.concatenate([sets[n] for n in nodes]))
            bits = None
            if len(words) <= _FULL_BITS:
                bits = np.zeros((len(nodes), -(-len(words) // 64) * 8), np.uint8)
                for k, n in enumerate(nodes):
                    marked = np.zeros(bits.shape[1] * 8, bool)
                    marked[np.searchsorted(words, sets[n])] = True
                    bits[k] = np.packbits(marked)
                bits = bits.view(np.uint64)
            sizes = np.array([len(sets[n]) for n in nodes])
            cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
            for part in np.split(pairs, cuts):
                i, js = int(part[0, 0]), part[:, 1]
                if bits is not None:
                    both = np.bitwise_count(bits[i] & bits[js]).sum(axis=1, dtype=np.int64)
                else:
                    both = np.array([len(np.intersect1d(sets[nodes[i]], sets[nodes[j]], assume_unique=True)) for j in js])
                for j in js[100 * both >= THRESHOLD_PERCENT * (sizes[i] + sizes[js] - both)].tolist():
                    if (a := find(i)) != (b := find(j)):
                        group[b] = a
                        left.append(nodes[i])
                        right.append(nodes[j])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def _block_links(members: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links between components in open buckets (band, node, component, main, and n, shingles, n_out, out of the bucket and of its nodes outside main)."""

    def parts(n: str, shingles: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / F.lit(BLOCK_NODES)), F.ceil(8 * F.col(shingles) / F.lit(BLOCK_BYTES))).cast("long")

    full = members.withColumns({"nx": parts("n_out", "out"), "ny": parts("n", "shingles")}).join(nodes.select("node", "bands", "bits"), "node")
    held = F.collect_list(F.struct("node", "component", "bands", "bits"))
    x, y = (F.pmod(F.xxhash64("node"), F.col(c)) for c in ("nx", "ny"))
    outside = materialise(full.where("component <> main").groupBy("band", x.alias("x"), "ny").agg(held.alias("left")), "op4-outside")
    every = materialise(full.groupBy("band", y.alias("y"), "nx", "main").agg(held.alias("right")), "op4-blocks")
    one = outside.select("band", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ny") - 1) / FACED))).alias("z"), "left")
    other = every.select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)).alias("x"), F.floor(F.col("y") / FACED).alias("z"), "y", "main", "right")
    facing = other.join(one, ["band", "x", "z"]).select("band", "x", "y", "main", "left", "right")
    near = materialise(facing.mapInArrow(_near_in_blocks, "band long, x long, y long, nodes array<binary>, pairs array<int>"), "op4-facing")
    owner = nodes.select("node", F.col("id").alias("owner"))
    wanted = near.select(F.explode("nodes").alias("node")).distinct().join(owner, "node")
    texts = materialise(documents.join(wanted, F.col("id").eqNullSafe(F.col("owner"))).select("node", "text"), "op4-second-texts")
    held = near.select("band", "x", "y", F.explode("nodes").alias("node")).join(texts, "node").groupBy("band", "x", "y").agg(F.collect_list(F.struct("node", "text")).alias("texts"))
    return near.join(held, ["band", "x", "y"]).select("nodes", "pairs", "texts").mapInArrow(_joined_in_blocks, "a binary, b binary").distinct()


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node with a link: the smallest node reachable.

    Minimum labels pass along the links and are short-cut through their own
    label, so that the rounds grow with the logarithm of a chain's length.
    """
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{label}-edges")
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), f"{label}-labels")
    while True:
        around = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("around"))
        nearer = materialise(labels.join(around, "node").select("node", "component", F.least("component", "around").alias("nearer")), f"{label}-nearer")
        jump = nearer.select(F.col("node").alias("nearer"), F.col("nearer").alias("jumped"))
        moved = materialise(nearer.join(jump, "nearer", "left").select("node", F.coalesce("jumped", "nearer").alias("next"), "component"), f"{label}-labels")
        labels = moved.select("node", F.col("next").alias("component"))
        if moved.where(F.col("next") != F.col("component")).isEmpty():
            return labels


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row.

    Null or wordless texts have an empty set and are their own component. Rows
    with equal sets share a component; component_id is its smallest id, nulls
    aside. A repeated row gives a repeated result. Texts are read whole, however
    long; no rows give no rows. Other columns play no part, whatever their names.
    """
    of_rows = components_of_rows(documents, id_col, text_col)
    return of_rows.select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    )


def with_node(documents: DataFrame, text_col: str = "text", node_col: str = "__of") -> DataFrame:
    """documents with the digest of each row's set as node_col; null without words."""
    rows, at, n = with_text(documents, text_col, documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(x.as_py()) for x in batch.column(at))
            nodes = pa.array([digest(h) if len(h) else None for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], nodes], [*batch.schema.names[:n], node_col])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema), f"`{node_col}` binary"])
    return rows.mapInArrow(run, out)


def _components_of_nodes(full: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component, component_id) of rows with a set."""
    owners = materialise(full.groupBy("node").agg(F.min("id").alias("id")), "op4-owners")
    nodes = materialise(
        full.select(F.col("node").alias("n"), F.col("id").alias("i"), "n_shingles", "bands", "bits")
        .join(owners, (F.col("n") == F.col("node")) & F.col("i").eqNullSafe(F.col("id")))
        .select("node", "id", "n_shingles", "bands", "bits")
        .dropDuplicates(["node"]),
        "op4-nodes",
    )
    in_bands = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = materialise(in_bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high"), "op4-buckets")
    buckets = materialise(in_bands.join(shared, "band"), "op4-members")
    ends = buckets.select("node", F.explode(F.array("low", "high")).alias("pivot")).where("node != pivot")
    pairs = ends.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    links = keeping(lambda: _links(pairs, nodes, docs, "op4-first"), "op4-first-links")
    labels = keeping(lambda: components(links, "op4-first"), "op4-first-components")

    members = materialise(
        buckets.select("band", "node", "n_shingles").join(labels, "node", "left").select("band", "node", "n_shingles", F.coalesce("component", "node").alias("component")),
        "op4-open",
    )
    sizes = members.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    largest = materialise(
        sizes.groupBy("band").agg(
            F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"),
            (F.sum("n") - F.max("n")).alias("n_out"), (F.sum("shingles") - F.max_by("shingles", F.struct("n", "component"))).alias("out"), F.count("*").alias("parts")
        ).where("parts > 1").drop("parts"),
        "op4-main",
    )
    more = keeping(lambda: _block_links(members.join(largest, "band"), nodes, docs), "op4-second-links")
    if not more.isEmpty():
        labels = keeping(lambda: components(links.union(more), "op4-second"), "op4-second-components")

    named = materialise(owners.join(labels, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component")), "op4-named")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("parts"))
    return named.join(least.where("parts > 1").drop("parts"), "component", "left").select("node", "component", F.coalesce("component_id", "id").alias("component_id"))


def components_of_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, node, component, component_id) for every row.

    node is the digest of the row's set and component the same for all nodes of
    a component; both are null for an empty set, which is its own component.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(docs.mapInArrow(_features, _FEATURES), "op4-features")
    full = rows.where("n_shingles > 0")
    of_node = keeping(lambda: _components_of_nodes(full, docs), "op4-components")
    linked = full.join(of_node, "node").select("id", "n_shingles", "node", "component", "component_id")
    none = F.lit(None).cast("binary")
    alone = rows.where("n_shingles = 0").select("id", "n_shingles", none.alias("node"), none.alias("component"), F.col("id").alias("component_id"))
    return linked.union(alone)
