"""Exact top-k search by inner product: a ball tree per shard, branch and bound.

Vectors become integers, ``floor(scale * x)``, held as doubles, which have them exactly at
any size, and dealt into shards of about ``SHARD_ROWS``
by a number given in the order of writing, so that copies spread. Each shard builds a ball
tree: a node has a centre, a radius and the least id below it, and no vector below it
scores more than ``q . centre + |q| * radius``. Queries come in blocks. A first pass
searches one shard per block; its k-th scores, which every other shard shares from the
start, are lower bounds that cut whole subtrees. Nodes are visited in the order of their
bounds and search ends at the first that cannot beat the k-th score; at an equal bound a
node is still entered if it holds an id small enough to win the tie. Bounds are rounded
upwards by more than their error, which goes with the lengths of the vectors and not with
the bound itself. Scores are exact integers, so the answer is that of comparing all pairs:
in doubles where every product and sum is below 2 ** 53, in 64-bit integers below 2 ** 63,
and beyond that in whole numbers of any size, worked out for those vectors alone whose
score in doubles, with its error, reaches the k-th.

The query set grows with the table. Queries are sent to every shard, ``queries x shards``
rows, never queries times vectors, and stream past its tree: a task holds the vectors of one
shard and one Arrow batch of queries.

Defined cases: a vector that is null or holds a null or a non-finite component (also after
scaling) takes no part, nor does a row with a null id; a pair whose score is no 64-bit
integer cannot be returned and is left out, its vectors stay for others; vectors of
different lengths never meet; equal rows (id and vector) count once; rows of one id with
different vectors are queries and candidates each, but not of each other; ties go to the
smaller id; fewer than k candidates give all of them; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.llm.common import Shared

SHARD_ROWS = 16_384
BLOCK_QUERIES = 512
LEAF = 64
#: Relative error of sums in doubles, with room to spare for a million components.
MARGIN = 1e-9

FOUND = "query_id long, query_row long, vec_id long, score long"


def prepare(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): whole-number vectors of the rows that take part, equal rows once."""
    def whole(x):
        y = F.lit(float(scale)) * x.cast("double")
        # From 2 ** 52 on a double is a whole number.
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)

    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, whole).alias("v")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite).dropDuplicates(["vec_id", "v"])


class BallTree:
    """Nodes over rows sorted so that each node is a slice; halves are equally large."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        order = np.arange(len(ids))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        points = vectors
        todo = [(0, len(ids), -1, 0)]
        while todo:
            first, last, parent, side = todo.pop()
            number = len(self.spans)
            self.spans.append((first, last))
            self.children.append(None)
            if parent >= 0:
                pair = self.children[parent] or (-1, -1)
                self.children[parent] = (number, pair[1]) if side == 0 else (pair[0], number)
            if last - first > leaf:
                own = order[first:last]
                block = points[own]
                spread = block.max(axis=0) - block.min(axis=0)
                if spread.size and spread.max() > 0:
                    half = len(own) // 2
                    own = own[np.argpartition(block[:, int(spread.argmax())], half)]
                else:  # Equal vectors: by id, so that a part can be cut for its ids.
                    half = len(own) // 2
                    own = own[np.argsort(ids[own], kind="stable")]
                order[first:last] = own
                todo.append((first + half, last, number, 1))
                todo.append((first, first + half, number, 0))
        self.vectors, self.ids = vectors[order], ids[order]
        points = points[order]
        self.centres = np.array([points[a:b].mean(axis=0) for a, b in self.spans])
        self.radii = np.array([
            np.sqrt(((points[a:b] - c) ** 2).sum(axis=1).max()) if b > a else 0.0
            for (a, b), c in zip(self.spans, self.centres, strict=True)
        ])
        self.least = np.array([self.ids[a:b].min() for a, b in self.spans])
        self.lengths = np.linalg.norm(self.centres, axis=1)
        self.largest = float(np.abs(points).max()) if points.size else 0.0
        self.integers: np.ndarray | None = None

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds, one row per query, one column per node, rounded upwards."""
        q = queries
        length = np.linalg.norm(q, axis=1)[:, None]
        spread = length * self.radii[None, :]
        with np.errstate(over="ignore", invalid="ignore"):
            bound = q @ self.centres.T + spread + (length * self.lengths[None, :] + spread) * MARGIN + 1e-6
        return np.where(np.isnan(bound), np.inf, np.floor(bound))

    def scorer(self, query: np.ndarray):
        """Exact scores of a slice of the rows: (first, last, least) -> (rows, whole numbers).

        Rows that score less than ``least`` may be left out.
        """
        most = self.largest * float(np.abs(query).max(initial=0.0)) * max(1, len(query))
        if most < 2.0**52:
            def doubles(first: int, last: int, least: int):
                scores = self.vectors[first:last] @ query
                rows = np.flatnonzero(scores >= least)
                return rows.tolist(), scores[rows].astype(np.int64).tolist()

            return doubles
        if most < 2.0**62 and self.largest < 2.0**62 and np.abs(query).max() < 2.0**62:
            if self.integers is None:
                self.integers = self.vectors.astype(np.int64)
            own = query.astype(np.int64)

            def integers(first: int, last: int, least: int):
                scores = self.integers[first:last] @ own
                rows = np.flatnonzero(scores >= least)
                return rows.tolist(), scores[rows].tolist()

            return integers
        whole = [int(x) for x in query.tolist()]

        def any_size(first: int, last: int, least: int):
            block = self.vectors[first:last]
            # What overflows, and so compares false, is worked out as well.
            with np.errstate(over="ignore", invalid="ignore"):
                error = (np.abs(block) @ np.abs(query)) * MARGIN
                rows = np.flatnonzero(~(block @ query + error < float(least) - 1.0)).tolist()
            scores = [sum(int(x) * y for x, y in zip(block[i].tolist(), whole, strict=True)) for i in rows]
            fit = [(i, x) for i, x in zip(rows, scores, strict=True) if -(2**63) <= x < 2**63 and x >= least]
            return [i for i, _ in fit], [x for _, x in fit]

        return any_size

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor: tuple[int, int]) -> list:
        """The k best (score, -id) that beat or equal ``floor``, found from the best node on."""
        best: list[tuple[int, int]] = []
        scores_of = self.scorer(query)
        heap = [(-bound[0], 0)]
        while heap:
            up, node = heapq.heappop(heap)
            limit = best[0] if len(best) == k else floor
            limit = max(limit, floor)
            if -up < limit[0]:
                break
            if -up == limit[0] and -int(self.least[node]) < limit[1]:
                continue
            pair = self.children[node]
            if pair:
                for child in pair:
                    heapq.heappush(heap, (-bound[child], child))
                continue
            first, last = self.spans[node]
            for i, score in zip(*scores_of(first, last, limit[0]), strict=True):
                found = (score, -int(self.ids[first + i]))
                if found[1] == -own or found < floor:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return best


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """Slices of a batch with equal shard, dims and asks."""
    marks = np.stack([batch.column(c).cast(pa.int32()).to_numpy() for c in ("shard", "dims", "asks")])
    cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        if last > first:
            shard, dims, asks = marks[:, first].tolist()
            yield (shard, dims), bool(asks), batch.slice(first, last - first)


def _vectors(rows: pa.RecordBatch, dims: int) -> np.ndarray:
    return rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(
        np.float64, copy=False
    ).reshape(rows.num_rows, dims)


def _search_shards(k: int):
    """Over rows sorted by (shard, dims, asks): the vectors of a shard, then its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, ids, tree = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            for place, asks, rows in _runs(batch):
                if place != here:
                    here, parts, ids, tree = place, [], [], None
                if not asks:
                    parts.append(_vectors(rows, place[1]))
                    ids.append(rows.column("id").to_numpy())
                    continue
                if tree is None:
                    if not parts:
                        continue
                    tree = BallTree(np.concatenate(parts), np.concatenate(ids))
                    parts, ids = [parts[0][:0]], [ids[0][:0]]
                for first in range(0, rows.num_rows, 256):
                    part = rows.slice(first, 256)
                    q = _vectors(part, place[1])
                    bounds = tree.bounds(q)
                    asked = zip(*[part.column(c).to_pylist() for c in ("id", "row", "kth", "kth_id")], strict=True)
                    for i, (own, row, kth, kth_id) in enumerate(asked):
                        for score, minus in tree.search(q[i], own, bounds[i], k, (kth, -kth_id)):
                            out.append((own, row, -minus, score))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_row", "vec_id", "score"]
            )

    return run


def search(vectors: DataFrame, k: int, is_query, vec_id: str = "vec_id", vector: str = "embedding",
           scale: int = 256, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row for which ``is_query(vec_id)`` holds."""
    shared = Shared(vectors.sparkSession)
    rows = shared.save(
        prepare(vectors, vec_id, vector, scale).withColumn("row", F.monotonically_increasing_id()), "vectors"
    )
    shards = max(1, -(-rows.count() // shard_rows))
    place = F.pmod(F.col("row") + F.shiftright("row", 33) * 7919, F.lit(shards)).cast("int")
    table = rows.select("vec_id", "v", place.alias("shard"), F.size("v").alias("dims"))
    none = np.iinfo(np.int64)
    queries = rows.where(is_query(F.col("vec_id"))).select(
        F.col("vec_id").alias("own"), F.col("v").alias("q"), F.col("row").alias("asked"), F.size("v").alias("dims"),
        F.pmod(F.xxhash64("row"), F.lit(max(1, -(-shards * shard_rows // (50 * block_queries))))).alias("block"),
    )

    def meet(asked: DataFrame) -> DataFrame:
        unset = F.lit(None).cast("long")
        held = table.select(
            "shard", "dims", F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v",
            unset.alias("row"), unset.alias("kth"), unset.alias("kth_id"),
        )
        asking = asked.select(
            "shard", "dims", F.lit(True).alias("asks"), F.col("own").alias("id"), F.col("q").alias("v"),
            F.col("asked").alias("row"), "kth", "kth_id",
        )
        dealt = held.unionByName(asking).repartition("shard", "dims")
        return dealt.sortWithinPartitions("shard", "dims", "asks").mapInArrow(_search_shards(k), FOUND)

    own_shard = F.pmod("block", F.lit(shards)).cast("int")
    start = queries.select(
        "own", "q", "asked", "dims", own_shard.alias("shard"),
        F.lit(int(none.min) + 1).alias("kth"), F.lit(int(none.max)).alias("kth_id"),
    )
    first = shared.save(meet(start), "first")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    kth = (
        first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k)
        .select(F.col("query_row").alias("asked"), F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    )
    rest = (
        queries.join(kth, "asked", "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .where(F.col("shard") != own_shard)
        .select(
            "own", "q", "asked", "dims", "shard",
            F.coalesce("kth", F.lit(int(none.min) + 1)).alias("kth"),
            F.coalesce("kth_id", F.lit(int(none.max))).alias("kth_id"),
        )
    )
    found = first.unionByName(meet(rest))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
