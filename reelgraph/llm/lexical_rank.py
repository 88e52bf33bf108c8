"""Ranked lexical search with the Best Position Algorithm.

Statistics come from one pass over all documents: their lengths and, of the terms that may
be asked for, the occurrences. What may be asked for goes to the tasks as a bit table of
fixed size. Document counts of terms are an aggregate over that table.

Lists. Documents are dealt into shards of about ``SHARD_DOCS`` rows by their number, so no
id or source can fill a shard. In a shard a term's list holds its documents by falling
impact; a second order by document gives direct access to a document's place in any list.

Search, per item and shard. All lists are read downwards together. A document met in one
list is looked up in the others at once, which marks its places there as seen. The best
position of a list is the end of the unbroken run of seen places from its top; nothing
unseen can have more impact than the entry after it. The sum of those entries, each times
its term's weight, bounds every unseen document. The search ends only when that bound lies
strictly below the k-th score, so documents that tie with it are met.

Sharing. A first pass searches a few shards; the k-th scores found there bound those of all
documents from below and stop the others earlier. Ranks are taken over what the shards
return, at most k rows of each.

Defined cases: null and empty texts have no terms and are not counted; texts are read whole;
rows with a null doc_id or item_id take no part; rows of one doc_id are documents of their
own; the texts of rows with one item_id are one query; items without terms, or of whose
terms no document holds any, give no rows; other columns are not read; empty tables give
no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.llm.bits import bit_table, may_hold
from reelgraph.llm.common import Shared
from reelgraph.llm.word_scores import each_part

#: Documents of a shard, and items searched by a task in one shard.
SHARD_DOCS = 8192
BLOCK_ITEMS = 512
#: One shard in so many is searched first, at least one.
FIRST = 32
#: First depth of reading; it doubles.
DEPTH = 16
#: Distinct terms whose bits a task keeps at most.
TERM_TABLE = 400_000

#: The scoring rule: scales, and how much of a document's length counts, in hundredths.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE, DAMPING = 1000, 1_000_000_000, 1000, 100, 25, 12

_TERM = re.compile(rb"[0-9a-z\x80-\xFF]+")


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text; ``bytes.lower`` changes A-Z alone."""
    return _TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def _hashes(terms: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_id, term, hash, repeats)."""
    for part in each_part(batches):
        owner, terms, repeats = [], [], []
        for k, text in enumerate(part.column(1).to_pylist()):
            for term, n in Counter(terms_of(text)).items():
                owner.append(k)
                terms.append(term)
                repeats.append(n)
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(owner, pa.int64())), pa.array(terms, pa.binary()).cast(pa.string()),
             pa.array(_hashes(terms).view(np.int64)), pa.array(repeats, pa.int64())],
            names=["item_id", "term", "hash", "repeats"],
        )


def _posting_rows(bits: bytes):
    """Rows (doc_id, n, terms, tfs): a document's length and its terms that pass the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits, np.uint8)
        passes: dict[bytes, bool] = {}
        for part in each_part(batches):
            counted = [Counter(terms_of(t)) for t in part.column(1).to_pylist()]
            fresh = list(set().union(*counted).difference(passes))
            if len(passes) > TERM_TABLE:
                passes.clear()
                fresh = list(set().union(*counted))
            passes.update(zip(fresh, may_hold(table, _hashes(fresh)).tolist(), strict=True))
            totals, sizes, terms, tfs = [], [0], [], []
            for counts in counted:
                totals.append(sum(counts.values()))
                kept = [t for t in counts if passes[t]]
                terms += kept
                tfs += map(counts.__getitem__, kept)
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(totals, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


class Lists:
    """Impact lists of one shard with direct access by document."""

    def __init__(self, ids: np.ndarray, damped: np.ndarray, docs: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        self.ids, self.docs_in = ids, len(ids)
        impacts = (IMPACT_SCALE * tfs) // (TF_SCALE * tfs + DAMPING * damped[docs])
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.impacts = docs[order], impacts[order]
        places = np.empty(len(order), np.int64)
        by_term = terms[order]
        count = int(by_term[-1]) + 1 if len(by_term) else 0
        self.bounds = np.searchsorted(by_term, np.arange(count + 1))
        places[order] = np.arange(len(order))
        keys = terms * self.docs_in + docs
        by_doc = np.argsort(keys)
        self.keys, self.places = keys[by_doc], places[by_doc]

    def find(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Places of documents in lists, -1 where a document is not in one."""
        wanted = terms[:, None] * self.docs_in + docs[None, :]
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.places[at], -1)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, deepest reading) of the k best with a score of ``floor`` or more.

        Equal scores go by id; documents below ``floor`` may be left out, none at or above it.
        """
        held = (terms < len(self.bounds) - 1) & (weights > 0)
        terms, weights = terms[held], weights[held]
        first, last = self.bounds[terms], self.bounds[terms + 1]
        held = last > first
        terms, weights, first, last = terms[held], weights[held], first[held], last[held]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return docs, scores, 0
        sizes = last - first
        base = np.cumsum(sizes) - sizes
        seen = np.zeros(int(sizes.sum()), bool)
        met = np.zeros(self.docs_in, bool)
        position = np.zeros(len(terms), np.int64)
        depth, step, longest = 0, DEPTH, int(sizes.max())
        while depth < longest:
            ahead = min(longest, depth + step)
            fresh = np.unique(np.concatenate([
                self.docs[f + depth:min(f + ahead, e)] for f, e in zip(first.tolist(), last.tolist(), strict=True)
            ]))
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            if len(fresh):
                places = self.find(terms, fresh)
                there = places >= 0
                row, _ = np.nonzero(there)
                seen[base[row] + places[there] - first[row]] = True
                gains = np.where(there, self.impacts[places], 0) * weights[:, None]
                docs = np.concatenate([docs, fresh])
                scores = np.concatenate([scores, gains.sum(axis=0)])
                if len(docs) > 4 * k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    docs, scores = docs[scores >= least], scores[scores >= least]
            depth, step = ahead, 2 * step
            bound = 0
            for t in range(len(terms)):
                rest = seen[base[t] + position[t]:base[t] + sizes[t]]
                gap = int(rest.argmin()) if len(rest) else 0
                position[t] += len(rest) if len(rest) and rest[gap] else gap
                if position[t] < sizes[t]:
                    bound += int(self.impacts[first[t] + position[t]]) * int(weights[t])
            kth = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0
            if bound < max(kth, floor):
                break
        order = np.lexsort((self.ids[docs], -scores))[:k]
        return docs[order], scores[order], depth


def _search(k: int, id_type: pa.DataType):
    def run(docs: pa.Table, items: pa.Table) -> pa.Table:
        docs, items = docs.combine_chunks(), items.combine_chunks()
        flat = docs.column("terms").combine_chunks() if docs.num_rows else None
        out_items, out_docs, out_scores = [], [], []
        if docs.num_rows and items.num_rows:
            asked = pc.unique(items.column("terms").combine_chunks().flatten())
            spelled = flat.flatten().dictionary_encode()
            code = pc.index_in(spelled.dictionary, asked).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            terms = code[spelled.indices.to_numpy()]
            owner = np.repeat(np.arange(docs.num_rows), np.asarray(flat.value_lengths()))
            tfs = docs.column("tfs").combine_chunks().flatten().to_numpy()
            kept = terms >= 0
            lists = Lists(
                docs.column("doc_id").to_numpy(), docs.column("damped").to_numpy(), owner[kept], terms[kept], tfs[kept]
            )
            for item, own, weights, floor in zip(
                items.column("item_id"), items.column("terms").to_pylist(), items.column("weights").to_pylist(),
                items.column("floor").to_pylist(), strict=True,
            ):
                codes = pc.index_in(pa.array(own, asked.type), asked).to_numpy().astype(np.int64)
                found, scores, _ = lists.best(codes, np.array(weights, np.int64), k, max(1, floor or 0))
                good = scores > 0
                out_items += [item.as_py()] * int(good.sum())
                out_docs.append(lists.ids[found[good]])
                out_scores.append(scores[good])
        return pa.table({
            "item_id": pa.array(out_items, id_type),
            "doc_id": pa.array(np.concatenate(out_docs) if out_docs else np.zeros(0, np.int64), pa.int64()),
            "score": pa.array(np.concatenate(out_scores) if out_scores else np.zeros(0, np.int64), pa.int64()),
        })

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, from rank 1.

    ``docs`` has doc_id (a whole number) and text, ``items`` item_id and text.
    """
    spark = docs.sparkSession
    shared = Shared(spark)
    id_field = items.schema["item_id"]
    asked = shared.save(
        items.where(F.col("item_id").isNotNull()).select("item_id", "text").mapInArrow(
            _query_terms, f"item_id {id_field.dataType.simpleString()}, term string, hash long, repeats long"
        ).groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"), F.first("hash").alias("hash")),
        "asked",
    )
    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    postings = shared.save(
        source.mapInArrow(
            _posting_rows(bit_table(asked, "hash")), "doc_id long, n long, terms array<string>, tfs array<long>"
        ).where("n > 0").withColumn("number", F.monotonically_increasing_id()),
        "postings",
    )
    count, length = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not count:
        return spark.createDataFrame([], f"item_id {id_field.dataType.simpleString()}, rank int, doc_id long, score long")
    held = postings.select(F.explode("terms").alias("held")).groupBy("held").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(WEIGHT_SCALE) * F.log(F.lit(2.0 * count + 2) / (2 * F.col("df") + 1)))
    weighted = asked.join(held, F.col("term") == F.col("held")).select(
        "item_id", "term", (weight * F.col("repeats")).alias("weight")
    ).where("weight > 0").groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("own"))
    blocks = max(1, -(-asked.select("item_id").distinct().count() // BLOCK_ITEMS))
    queries = shared.save(
        weighted.select(
            "item_id", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"),
            F.col("own.term").alias("terms"), F.col("own.weight").alias("weights"),
        ),
        "queries",
    )
    shards = max(1, -(-count // SHARD_DOCS))
    damped = F.lit(LENGTH_SCALE - LENGTH_SHARE) + F.expr(f"({LENGTH_SHARE} * n * {count}L) div {length}L")
    dealt = postings.select(
        "doc_id", damped.alias("damped"), "terms", "tfs",
        F.pmod(F.xxhash64("number"), F.lit(shards)).alias("shard"),
        _each(0, blocks).alias("block"),
    )
    first = max(1, shards // FIRST)

    def searched(low: int, high: int, asking: DataFrame) -> DataFrame:
        spread = asking.withColumn("shard", _each(low, high))
        return dealt.where((F.col("shard") >= low) & (F.col("shard") < high)).groupBy("shard", "block").cogroup(
            spread.groupBy("shard", "block")
        ).applyInArrow(
            _search(k, _arrow_type(id_field)), f"item_id {id_field.dataType.simpleString()}, doc_id long, score long"
        )

    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = shared.save(searched(0, first, queries.withColumn("floor", F.lit(1).cast("long"))), "first")
    if first < shards:
        kth = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(
            F.col("item_id").alias("known"), F.col("score").alias("floor")
        )
        rest = queries.join(kth, F.col("item_id") == F.col("known"), "left").drop("known")
        found = found.unionByName(shared.save(searched(first, shards, rest), "rest"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "item_id", F.col("rank").cast("int"), "doc_id", "score"
    )


def _each(low: int, high: int) -> F.Column:
    return F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long")))


def _arrow_type(field) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)
