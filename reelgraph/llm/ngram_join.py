"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments, and
a document's set falls into one segment per fragment.

Candidates. Two sets with ``100 * common >= percent * union`` differ in so few n-grams
(their symmetric difference is at most ``(100 - percent) / (100 + percent)`` of the sum of
sizes) that of more fragments than that at least one holds equal segments. Sizes fall into
classes whose bounds grow by half; a class has more fragments than its largest possible
difference, and a set so large that a partner may lie in the next class is cut for that
class too. Keys of segments are combined in chunks of a task, cross the network once, a
part of them at a time, and are kept where two sets meet. Two linked sets share ``need`` of
them at least, so the rarest key they share is not among the last ``need - 1`` of either
when a set's keys go from rare to common. Those are left out: passages that many texts have
hold no families together. Sets that share one of the others are joined to families by
components over (set, smallest set of the segment), so that no pair is made.

Counting. The sets of a family are dealt into blocks; each pair of blocks is one group.
There the order is cut again, partial overlaps are counted per fragment for all pairs of
the two blocks at once, and summed per pair. The sums decide, exactly. A group hands on the
links of a spanning forest, so a family of n equal-minded copies gives about n links
per pair of blocks and never n * n rows.

Equal sets are one row from the start, told by 128 bits of hash. Empty segments are keys
only of a set that has unusually many, and then a second cut is part of each such key, so
that empty segments alone make no family.

Defined cases: a null text or one without words has the empty set and is linked with
nothing; shorter texts have their whole sequence as the one n-gram; texts are used whole;
repeated rows of an id have the component of their own set each; rows with a null id link
nothing, and get the smallest id among the documents of their set, or null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.llm.common import Shared
from reelgraph.llm.components import connected
from reelgraph.llm.word_scores import Words, each_part, mix

#: Growth of size classes.
GROWTH = 1.5
#: Sets and n-grams in a block, on average.
BLOCK_SETS = 512
BLOCK_GRAMS = 1 << 20
#: Distinct n-grams of one fragment while overlaps are counted.
FRAGMENT = 4_096
#: Keys that a task combines before they are shuffled.
CHUNK_KEYS = 1 << 20
#: Parts of the keys that are shuffled one after the other: only one is on disk at a time.
KEY_PARTS = 4
#: Sets a task remembers, so that equal ones are cut once.
SEEN_SETS = 200_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Grams:
    """Sorted distinct n-gram hashes of texts."""

    def __init__(self, n: int):
        self.n = n

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        words = Words(pc.ascii_lower(texts.cast(pa.string())))
        hashes = words.hashes()
        bounds = words.offsets.tolist()
        full = np.zeros(max(0, len(hashes) - self.n + 1), np.uint64)
        for k in range(self.n):
            full = full * _STEP + hashes[k:len(hashes) - self.n + 1 + k]
        full = mix(full)
        return [
            np.unique(full[a:b - self.n + 1]) if b - a >= self.n else self._short(hashes[a:b])
            for a, b in zip(bounds, bounds[1:])
        ]

    def _short(self, hashes: np.ndarray) -> np.ndarray:
        """The whole sequence of a text with fewer words, marked as such; none without words."""
        out = np.ones(min(len(hashes), 1), np.uint64)
        for h in hashes:
            out = out * _STEP + h
        return mix(out)


def size_class(size: int) -> int:
    """The class whose bounds hold ``size``: from ``low(c)`` up to below ``low(c + 1)``."""
    c = int(math.log(size, GROWTH))
    while low(c + 1) <= size:
        c += 1
    while low(c) > size:
        c -= 1
    return c


def low(c: int) -> int:
    return math.ceil(GROWTH**c)


@functools.cache
def fragments(c: int, percent: int) -> tuple[int, int]:
    """Fragments of class ``c``, and how many of them may be empty in a set.

    One more than sets up to the class's upper bound may differ in, and some to spare: two
    linked sets have more equal segments than the spare, so one that is not empty unless
    both have more empty segments. The spare that gives the fewest keys is taken.
    """
    largest = low(c + 1) - 1
    smallest = max(1, percent * low(c) // 100)  # Sets of the class below come this far.
    least = 2 * largest * (100 - percent) // (100 + percent) + 1

    def keys(spare: int) -> float:
        count = least + spare
        mean = count * (1 - 1 / count) ** smallest
        if not mean:
            return count
        # Number of empty segments as a Poisson variable.
        terms = (math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(spare + 1))
        return count + max(0.0, 1 - sum(terms)) * mean * count

    spare = min(range(0, least, max(1, least // 50)), key=keys)
    return least + spare, spare


def classes_of(size: int, percent: int) -> list[int]:
    """Classes in which a set is cut: its own, and the next if a partner may lie there."""
    c = size_class(size)
    return [c, c + 1] if 100 * size >= percent * low(c + 1) else [c]


def _cut(grams: np.ndarray, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every segment, and which segments are empty."""
    where = (mix(grams + np.uint64(seed)) >> np.uint64(33)).astype(np.int64) % count
    order = np.argsort(where, kind="stable")
    held = np.bincount(where, minlength=count)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams * _STEP + np.uint64(seed))[order], dtype=np.uint64)])
    ends = np.cumsum(held)
    return sums[ends] - sums[ends - held], held == 0


def segment_keys(grams: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """Per class (need, keys): a key per segment, and how many of them any linked set shares.

    Where more segments are empty than spared, those give the keys of a second cut.
    """
    out: list[tuple[int, np.ndarray]] = []
    if not len(grams):
        return out
    for c in classes_of(len(grams), percent):
        count, spare = fragments(c, percent)
        sums, empty = _cut(grams, count, 1)
        names = (np.uint64(c) << np.uint64(40)) + np.arange(count, dtype=np.uint64)
        keys, need = [mix(sums[~empty] + mix(names[~empty]))], max(1, spare + 1 - int(empty.sum()))
        if empty.sum() > spare:
            second, _ = _cut(grams, count, 2)
            inner = mix(second + mix(np.arange(count, dtype=np.uint64) + _STEP))
            keys.extend(mix(inner + name) for name in mix(names[empty] + _MIX))
        out.append((need, np.unique(np.concatenate(keys))))
    return out


def describe(docs: DataFrame, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, cuts) of every row; a cut is (need, keys).

    Of equal sets at least one row has the cuts; others of its task may have none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        grams = Grams(n)
        seen: set[bytes] = set()
        for part in each_part(batches):
            sizes, first, second, cuts = [], [], [], []
            for doc, own in zip(part.column(0).to_pylist(), grams.of(part.column(1)), strict=True):
                digest = xxhash.xxh3_128_digest(own.tobytes())
                sizes.append(len(own))
                first.append(int.from_bytes(digest[:8], "little", signed=True))
                second.append(int.from_bytes(digest[8:], "little", signed=True))
                if doc is None or digest in seen:  # An equal set of this task has given its keys.
                    cuts.append([])
                    continue
                cuts.append(segment_keys(own, percent))
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(digest)
            inner = [keys.view(np.int64) for own in cuts for _, keys in own]
            flat = np.concatenate(inner) if inner else np.zeros(0, np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, inner)]), pa.int32()), pa.array(flat))
            need = pa.array([need for own in cuts for need, _ in own], pa.int32())
            pairs = pa.StructArray.from_arrays([need, keys], ["need", "keys"])
            offsets = pa.array(np.cumsum([0, *map(len, cuts)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()), pa.ListArray.from_arrays(offsets, pairs),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "cuts"],
            )

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, cuts array<struct<need:int,keys:array<long>>>"
    )


def _node(set_a: str, cut: str):
    """A set and its cut as one number; the set keeps 63 bits."""
    return F.expr(f"shiftleft(shiftright({set_a}, 1), 1)").bitwiseOR(F.col(cut).cast("long"))


KEYS = "key long, node long"


def _chunk_keys(inside: bool, part: int = 0, parts: int = 1):
    """Rows (key, node) of the cuts of sets, by chunks of about ``CHUNK_KEYS`` keys.

    A key's smallest node in a chunk stands for the others (a key of very many sets is one
    row a chunk); with ``inside`` the rows of all nodes of keys that a chunk holds twice.
    Of ``parts`` parts of the keys only ``part`` is given.
    """
    def flush(keys: list[np.ndarray], nodes: list[int], sizes: list[int]) -> pa.RecordBatch:
        key = np.concatenate(keys)
        node = np.repeat(np.array(nodes, np.int64), sizes)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        if inside:
            fresh = first | np.concatenate([[True], node[1:] != node[:-1]])
            key, node, first = key[fresh], node[fresh], first[fresh]
            taken = ~(first & np.concatenate([first[1:], [True]]))
        else:
            taken = first
        return pa.RecordBatch.from_arrays([pa.array(key[taken]), pa.array(node[taken])], names=["key", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        nodes: list[int] = []
        sizes: list[int] = []
        held = 0
        for rows in each_part(batches):
            for set_a, cuts in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                for cut, own in enumerate(cuts.values or ()):
                    flat = own["keys"].values.to_numpy()
                    held += len(flat)  # All parts have the same chunks.
                    if parts > 1:
                        flat = flat[flat % parts == part]
                    if len(flat):
                        keys.append(flat)
                        nodes.append(set_a >> 1 << 1 | cut)
                        sizes.append(len(flat))
                if held >= CHUNK_KEYS:
                    if keys:
                        yield flush(keys, nodes, sizes)
                    keys, nodes, sizes, held = [], [], [], 0
        if keys:
            yield flush(keys, nodes, sizes)

    return run


def family_edges(keys: DataFrame) -> DataFrame:
    """Edges (a, b) between sets that hold together what may be linked.

    ``keys`` (key, node, need): the keys a cut shares with others, and how many of them a
    linked set has at least. Of a cut's keys the ``need - 1`` commonest are left out; the
    order is that of all sets, so two linked ones keep the rarest key of both.
    """
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_held")).where("_held > 1")
    held = held.select(F.col("key").alias("_key"), "_held")
    own = Window.partitionBy("node")
    ranked = keys.join(held, F.col("key") == F.col("_key")).select(
        "key", "node", "need", F.row_number().over(own.orderBy("_held", "key")).alias("_place"),
        F.count(F.lit(1)).over(own).alias("_n"),
    )
    left = ranked.where("_place <= _n - need + 1").select("key", F.expr("shiftright(node, 1)").alias("set_a"))
    lows = left.groupBy("key").agg(F.min("set_a").alias("low"), F.max("set_a").alias("high"))
    lows = lows.where("low != high").select(F.col("key").alias("shared_key"), "low")
    return left.join(lows, F.col("key") == F.col("shared_key")).select(
        F.col("set_a").alias("a"), F.col("low").alias("b")
    ).distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of every pair: partial counts per fragment of the order, summed."""
    both = left + right
    total = np.zeros((len(left), len(right)))
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    flat = np.concatenate(both)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    last = np.concatenate([first[1:], [True]])
    shared = ~(first & last)  # An n-gram of one set only adds nothing.
    rank, owner = np.cumsum(first)[shared], owner[shared]
    rank = np.unique(rank, return_inverse=True)[1] if len(rank) else rank
    kinds = int(rank[-1]) + 1 if len(rank) else 0
    bounds = np.searchsorted(rank, np.arange(0, kinds + FRAGMENT, FRAGMENT))
    for k in range(len(bounds) - 1):
        a, b = bounds[k], bounds[k + 1]
        held = np.zeros((len(both), FRAGMENT), np.float32)
        held[owner[a:b], rank[a:b] - k * FRAGMENT] = 1
        total += held[:len(left)] @ held[len(left):].T
    return total.astype(np.int64)


def _links(n: int, percent: int):
    grams = Grams(n)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        same = bool((frame["side"] == 2).any())
        lefts = frame[frame["side"] != 1]
        rights = lefts if same else frame[frame["side"] == 1]
        out: list[tuple[int, int]] = []
        if len(lefts) and len(rights):
            a = grams.of(pa.array(lefts["text"], pa.string()))
            b = a if same else grams.of(pa.array(rights["text"], pa.string()))
            common = overlaps(a, b)
            union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - common
            at, to = np.nonzero(100 * common >= percent * union)
            out = _forest(lefts["rep"].to_numpy(), rights["rep"].to_numpy(), at, to)
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _forest(left: np.ndarray, right: np.ndarray, at: np.ndarray, to: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the links before them left apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for x, y in zip(left[at].tolist(), right[to].tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def join(docs: DataFrame, n: int = 3, percent: int = 90, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    shared = Shared(docs.sparkSession)
    described = shared.save(describe(docs, n, percent, doc_id, text), "described")
    named = described.where("doc_id is not null and n_shingles > 0")
    table = shared.save(described.drop("cuts"), "table")
    # The representative of equal sets: their smallest id.
    sets = shared.save(
        named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size")), "sets"
    )
    cuts = named.select("set_a", "cuts")
    # Keys cross the network once: one row of a key per chunk, sorted into runs.
    run = Window.partitionBy("key")
    beyond = []
    for part in range(KEY_PARTS):
        probes = cuts.mapInArrow(_chunk_keys(False, part, KEY_PARTS), KEYS)
        met = probes.withColumn("low", F.min("node").over(run)).withColumn("high", F.max("node").over(run))
        beyond.append(shared.save(met.where("low != high").select("key", "node"), f"met{part}"))
    inside = cuts.mapInArrow(_chunk_keys(True), KEYS)
    # Keys that meet in a chunk only make other sets of that chunk members of the key.
    rows = shared.save(functools.reduce(DataFrame.union, beyond, inside).distinct(), "shared_keys")
    for part in range(KEY_PARTS):
        shared.drop(f"met{part}")
    needs = shared.save(
        named.select("set_a", F.posexplode("cuts").alias("cut", "of"))
        .select(_node("set_a", "cut").alias("_node"), F.col("of.need").alias("need")).distinct(),
        "needs",
    )
    shared.drop("described")
    # A linked set shares more keys than a passage gives: sets with fewer go.
    counted = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    enough = counted.join(needs, F.col("node") == F.col("_node")).where("n >= need").select("_node", "need")
    left = shared.save(
        rows.join(enough, F.col("node") == F.col("_node")).select("key", "node", "need"), "enough"
    )
    shared.drop("shared_keys")
    shared.drop("needs")
    edges = family_edges(left)
    families = shared.save(connected(edges), "families")
    shared.drop("enough")
    members = shared.save(
        sets.join(families, F.expr("shiftright(set_a, 1)") == F.col("node")).select("rep", "size", F.col("component").alias("family")),
        "members",
    )
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("grams"))
    sizes = sizes.select(
        F.col("family").alias("of"),
        F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"),
    )
    placed = members.join(sizes, F.col("family") == F.col("of")).select(
        "rep", "family", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    )
    source = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
    # One kind of join at every size: the side that is not the text grows with it. Texts go
    # to the blocks, as they take less room than the hashes of their n-grams.
    texts = source.join(placed.hint("merge"), "rep")
    # A block meets itself and every other one once: (smaller, larger).
    met = texts.select("rep", "family", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select(
        "rep", "family", "text", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    links = met.groupBy("family", "i", "j").applyInPandas(_links(n, percent), "a long, b long")
    linked = connected(links)
    resolved = sets.join(linked, F.col("rep") == F.col("node"), "left").select(
        F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), F.coalesce("component", "rep").alias("component")
    )
    return table.join(
        resolved, (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")), "left"
    ).select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.least("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )

