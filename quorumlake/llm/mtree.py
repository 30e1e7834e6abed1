"""Exact top-k inner products by best-first search in M-trees.

Inner products become distances: x of norm |x| gets one more component
sqrt(M^2 - |x|^2), M the largest norm of its shard, queries get a zero there; then
d^2 = |q|^2 + M^2 - 2 q.x, so the nearest are the highest scores.

build_index deals vectors into shards of bounded size and stores each shard's M-tree
once: its entries page by page, each with its distance to the page's routing object,
and its nodes with routing object, covering radius, distance to the parent's object and
the range of their children or entries. search_index brings blocks of queries to the
stored shards. A task searches a shard best-first for each query of a block, and a
query's best K of every shard are then ranked together. The queries are a stated set,
compared with all rows in blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

K = 20
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
PAGE = 512
FAN_OUT = 12


def _away(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - centre) ** 2).sum(axis=1), 0.0))


class MTree:
    """Nodes in an order in which a node's children, and a leaf's entries, stand in a row.

    first and count give that row, leaf says which of both it is. largest is M^2.
    """

    #: What of a tree is stored beside its vectors.
    FIELDS = ("centres", "radii", "to_parent", "first", "count", "leaf", "to_centre", "largest")

    def __init__(self, stored: dict[str, np.ndarray]) -> None:
        self.centres, self.radii, self.to_parent = stored["centres"].reshape(len(stored["radii"]), -1), stored["radii"], stored["to_parent"]
        self.first, self.count, self.leaf = stored["first"].tolist(), stored["count"].tolist(), stored["leaf"].tolist()
        self.to_centre, self.largest = stored["to_centre"], float(stored["largest"][0])

    @staticmethod
    def build(vectors: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The order of vectors' rows, page by page, and FIELDS."""
        norms = (vectors.astype(float) ** 2).sum(axis=1)
        points = np.column_stack([vectors.astype(float), np.sqrt(norms.max() - norms)])
        rng = np.random.default_rng(7)
        rows, centres, to_parent, first, leaf = [np.arange(len(points))], [], [0.0], [], []
        centres.append(_routing(points, rows[0]))
        k, order = 0, []
        while k < len(rows):
            here = rows[k]
            leaf.append(len(here) <= PAGE)
            if leaf[k]:
                first.append(sum(map(len, order)))
                order.append(here)
            else:
                first.append(len(rows))
                for part in _parts(points, here, rng):
                    rows.append(part)
                    centres.append(_routing(points, part))
                    to_parent.append(float(_away(centres[-1][None, :], centres[k])[0]))
            k += 1
        count = [len(r) if is_leaf else 0 for r, is_leaf in zip(rows, leaf, strict=True)]
        inner = [k for k in range(len(rows)) if not leaf[k]]
        bounds = [*(first[k] for k in inner), len(rows)]
        for k, low, high in zip(inner, bounds[:-1], bounds[1:], strict=True):
            count[k] = high - low
        to_centre = np.concatenate([_away(points[rows[k]], centres[k]) for k in range(len(rows)) if leaf[k]])
        radii = np.array([_away(points[r], c).max() for r, c in zip(rows, centres, strict=True)])
        made = {"centres": np.concatenate(centres), "radii": radii, "to_parent": np.array(to_parent), "first": np.array(first), "count": np.array(count), "leaf": np.array(leaf)}
        return np.concatenate(order), made | {"to_centre": to_centre, "largest": np.array([norms.max()])}

    def search(self, query: np.ndarray, k: int, score, own: int) -> list[tuple[int, int]]:
        """The k best (score, -id) pairs; score(places) gives exact scores and ids, own is an id to leave out."""
        square = float((query**2).sum())
        slack = 1e-6 * (1.0 + math.sqrt(square) + float(self.radii[0]))
        best: list[tuple[int, int]] = []
        reach = math.inf  # the distance of the k-th best
        heap = [(0.0, 0, float(_away(self.centres[:1], query)[0]))]
        while heap:
            bound, node, at = heapq.heappop(heap)
            if bound > reach + slack:
                break
            low, high = self.first[node], self.first[node] + self.count[node]
            if self.leaf[node]:
                places: slice | np.ndarray = slice(low, high)
                # By the triangle inequality |at - to_centre| is a lower bound, without a distance being computed.
                near = np.abs(at - self.to_centre[low:high]) <= reach + slack
                if not near.all():
                    places = low + np.flatnonzero(near)
                    if not len(places):
                        continue
                scores, ids = score(places)
                if len(best) == k:
                    better = np.flatnonzero(scores >= best[0][0])
                    scores, ids = scores[better], ids[better]
                for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                    if i != own:
                        if len(best) < k:
                            heapq.heappush(best, (s, -i))
                        elif (s, -i) > best[0]:
                            heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    reach = math.sqrt(max(0.0, square + self.largest - 2.0 * best[0][0]))
                continue
            children = np.arange(low, high)
            children = children[np.abs(at - self.to_parent[low:high]) - self.radii[low:high] <= reach + slack]
            away = _away(self.centres[children], query)
            for c, d, least in zip(children.tolist(), away.tolist(), (away - self.radii[children]).tolist(), strict=True):
                if least <= reach + slack:
                    heapq.heappush(heap, (max(least, bound), c, d))
        return sorted(best, reverse=True)


def _routing(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The point nearest to the mean of rows."""
    inside = points[rows]
    return inside[int(np.argmin(_away(inside, inside.mean(axis=0))))]


def _parts(points: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """rows by the nearest of at most FAN_OUT seeds; equal or nearly equal rows by number."""
    inside = points[rows]
    n = min(FAN_OUT, math.ceil(len(rows) / PAGE))
    seeds = points[rng.choice(rows, n, replace=False)]
    for _ in range(3):
        near = ((seeds**2).sum(axis=1) - 2 * inside @ seeds.T).argmin(axis=1)
        seeds = np.array([inside[near == k].mean(axis=0) if (near == k).any() else seeds[k] for k in range(n)])
    parts = [rows[near == k] for k in range(n) if (near == k).any()]
    return parts if len(parts) > 1 and max(map(len, parts)) <= 0.9 * len(rows) else np.array_split(rows, n)


def _pack(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """One row per group of about limit vectors of one dimension: their ids and components."""
    per = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(limit)))
    sized = rows.join(rows.groupBy("dim").agg(F.count("*").alias("n")), "dim")
    return (
        sized.withColumn(key, F.pmod(F.xxhash64("vec_id"), per))
        .groupBy("dim", key)
        .agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows"))
        .select(F.col("dim").alias(f"{key}_dim"), F.col("rows.vec_id").alias(f"{key}_ids"), F.flatten("rows.v").alias(f"{key}_parts"))
    )


def _flat(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


_TREE = ", ".join(f"{f} array<{'boolean' if f == 'leaf' else 'bigint' if f in ('first', 'count') else 'double'}>" for f in MTree.FIELDS)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, parts = _flat(batch.column(1), k), _flat(batch.column(2), k)
            vectors = parts.reshape(len(ids), -1)
            order, tree = MTree.build(vectors)
            columns = [batch.column(0).slice(k, 1), pa.array([ids[order]]), pa.array([vectors[order].ravel()]), *(pa.array([tree[f]]) for f in MTree.FIELDS)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *MTree.FIELDS])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            ids, queries = _flat(column["shard_ids"], k), _flat(column["block_ids"], k)
            x, q = (_flat(column[f"{side}_parts"], k).reshape(len(n), -1) for side, n in (("shard", ids), ("block", queries)))
            tree = MTree({f: _flat(column[f], k) for f in MTree.FIELDS})
            exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < 2**53
            xs = np.ascontiguousarray(x.astype(float) if exact else x)
            found = []
            for own, vector in zip(queries.tolist(), q, strict=True):
                v = vector.astype(xs.dtype)

                def score(places: slice | np.ndarray, v: np.ndarray = v) -> tuple[np.ndarray, np.ndarray]:
                    return xs[places] @ v, ids[places]

                found += [(own, -i, int(s)) for s, i in tree.search(np.append(vector.astype(float), 0.0), K, score, own)]
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): components floor(64 x); vectors without an id, that are null, or that hold null or non-finite components are left out.

    Other columns play no part, whatever their names.
    """
    parts = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        embeddings.select(F.col(id_col).cast("long").alias("vec_id"), parts.alias("p"))
        .where(F.col("vec_id").isNotNull() & F.col("p").isNotNull() & sound)
        .select("vec_id", F.transform("p", lambda x: F.floor(x * 64).cast("long")).alias("v"), F.size("p").alias("dim"))
    )


def build_index(vectors: DataFrame) -> DataFrame:
    """One stored row per shard of vectors (vec_id, v, dim): ids and components page by page, and the shard's tree."""
    packed = materialise(_pack(vectors, "shard", SHARD_ROWS), "op7-shards")
    packed = packed.withColumn("deal", F.monotonically_increasing_id()).repartition(spread(packed), "deal").drop("deal")
    return materialise(packed.mapInArrow(_built, f"shard_dim int, shard_ids array<bigint>, shard_parts array<bigint>, {_TREE}"), "op7-index")


def search_index(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's K highest scores among all other ids of the index."""
    blocks = materialise(_pack(queries.dropDuplicates(["vec_id"]), "block", BLOCK_QUERIES), "op7-blocks")
    pairs = index.join(blocks, F.col("shard_dim") == F.col("block_dim")).withColumn("deal", F.monotonically_increasing_id())
    pairs = pairs.repartition(spread(pairs), "deal").drop("deal")
    best = pairs.mapInArrow(_searched, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def top_inner_products(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's K highest scores among all other ids.

    Ties go to the smaller vec_id. Vectors of another dimension than the query's
    are no candidates; repeated candidate rows count each, repeated query rows once.
    An empty table gives no rows.
    """
    return search_index(build_index(vectors), queries)


def spread(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
