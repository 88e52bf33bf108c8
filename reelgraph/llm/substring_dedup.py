"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words of one document. A word goes if it lies in a
window whose words also start in a document with a smaller id.

Where to look. A window's anchor is that of its phrases of ``PHRASE`` words whose hash is
smallest, so equal windows have equal anchors, and anchors are a fifth of all phrases.
Anchors held by two documents or more are found by an aggregate. Only stretches of text
around such an anchor (the windows whose anchor it is) go on.

Confirming and compiling. Equal stretches are one row with the smallest and the largest id
that hold them. They are dealt into shards by anchor; an anchor with many stretches is
split by its windows' hashes, each stretch going to the parts that its windows fall in. In
a shard, windows that two documents hold are confirmed word for word, with the smallest id
that holds each, joined to passages (longest runs with the same smallest id) and compiled
into an Aho-Corasick automaton over words.

Locating. Every stretch streams through its shard's automaton, which gives all places of
confirmed passages at once; the documents of a stretch take those with a smaller id. Ranges
are gathered per document and cut from its text.

Defined cases: a null text has no words; shorter texts than a window lose nothing; texts
are read whole; rows of one id do not make each other go; a row with a null id keeps all
its words and takes none from others; an empty table gives no rows; other columns are
carried by ``cut`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from reelgraph.llm.common import Shared
from reelgraph.llm.word_scores import Words, each_part, mix, words_of

WINDOW = 13
PHRASE = 4
#: Texts read at once.
TEXTS = 1_024
#: Distinct stretches of one anchor in one part of a shard, on average.
PART_STRETCHES = 256
#: Stretches of one shard, on average.
SHARD_STRETCHES = 20_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * _STEP + words[k:len(words) - n + 1 + k]
    return mix(out)


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every anchor: its text, its phrase hash, and its first and last window.

    The leftmost smallest phrase hash of a window; hash and place are compared together.
    Windows are numbered by the place of their first word in ``words``.
    """
    starts, owner = words.starts(window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    phrases = run_hashes(words.hashes(), PHRASE)
    windows = np.lib.stride_tricks.sliding_window_view(phrases, window - PHRASE + 1)
    place = (np.arange(len(windows)) + windows.argmin(axis=1))[starts]
    fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    last = np.concatenate([np.nonzero(fresh)[0][1:], [len(starts)]]) - 1
    return owner[fresh], phrases[place[fresh]], starts[fresh], starts[last]


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in each_part(batches, TEXTS):
            owner, keys, _, _ = anchors(Words(part.column(1)), window)
            offsets = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64))),
                ],
                names=["doc_id", "digest", "anchors"],
            )

    return run


def _stretch_rows(window: int):
    """Rows (anchor, stretch, first word, doc) of the anchors listed for a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in each_part(batches, TEXTS):
            words = Words(part.column("text"))
            owner, keys, first, last = anchors(words, window)
            lists = part.column("places")
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            taken = np.unique(np.searchsorted(owner, row) + lists.flatten().to_numpy())
            owner, keys, first, last = owner[taken], keys[taken], first[taken], last[taken]
            # One space between words; a stretch is cut out of that by bytes.
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(words.flat).to_numpy().astype(np.int64) + 1)])
            lists = pa.ListArray.from_arrays(pa.array(words.offsets, pa.int32()), words.flat)
            joined = b" ".join(pc.binary_join(lists, " ").cast(pa.binary()).filter(
                pa.array(np.diff(words.offsets) > 0)
            ).to_pylist())
            texts = [
                joined[a:b] for a, b in zip(
                    sizes[first].tolist(), (sizes[last + window] - 1).tolist(), strict=True
                )
            ]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(rows), part.column("digest").take(rows),
                    pa.array(keys.view(np.int64)), pa.array(texts, pa.binary()),
                    pa.array(first - words.offsets[owner]),
                ],
                names=["doc_id", "digest", "anchor", "stretch", "first"],
            )

    return run


STRETCHES = "doc_id long, digest long, anchor long, stretch binary, first long"


def _part_rows(window: int):
    """Deals a stretch to the parts of its anchor in which its windows fall."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "stretch", "low", "high"]
        for part in each_part(batches, 4096):
            counts = part.column("parts").to_numpy(zero_copy_only=False).astype(np.int64)
            several = np.nonzero(counts > 1)[0]
            rows, parts = np.nonzero(counts == 1)[0], np.zeros(int((counts == 1).sum()), np.int64)
            if len(several):
                words = Words(part.column("stretch").take(pa.array(several)))
                starts, owner = words.starts(window)
                owner = several[owner]
                own = run_hashes(words.hashes(), window)[starts] % counts[owner].astype(np.uint64)
                dealt = np.unique(np.stack([owner, own.astype(np.int64)]), axis=1)
                rows, parts = np.concatenate([rows, dealt[0]]), np.concatenate([parts, dealt[1]])
            taken = part.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [taken.column(c) for c in names] + [taken.column("parts"), pa.array(parts, pa.int32())],
                names=[*names, "parts", "part"],
            )

    return run


def same_windows(codes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in an order that puts equal ones together, and where each kind begins.

    Grouped by hash, then compared word for word; kinds whose hashes meet are told apart.
    """
    hashes = run_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), window)[starts]
    order = np.argsort(hashes, kind="stable")
    hashes, at = hashes[order], starts[order]
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    lead = at[np.nonzero(first)[0][np.cumsum(first) - 1]]
    if all((codes[at + k] == codes[lead + k]).all() for k in range(window)):
        return order, np.nonzero(first)[0]
    order = np.lexsort([codes[starts + k] for k in range(window)])
    at = starts[order]
    first = np.ones(len(at), bool)
    first[1:] = np.any([codes[at[1:] + k] != codes[at[:-1] + k] for k in range(window)], axis=0)
    return order, np.nonzero(first)[0]


def _locate(window: int):
    """Confirms windows that two documents hold, joins them to passages, compiles those and
    streams the stretches.

    A passage is a longest run of confirmed windows of one stretch that the same id holds
    first. Only the automaton says where passages lie.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        words = Words(pa.array(frame["stretch"], pa.binary()))
        low, high = frame["low"].to_numpy(), frame["high"].to_numpy()
        starts, owner = words.starts(window)
        out: list[tuple] = []
        if len(starts):
            order, first = same_windows(words.codes, starts, window)
            lowest = np.minimum.reduceat(low[owner[order]], first)
            confirmed = lowest != np.maximum.reduceat(high[owner[order]], first)
            kind = np.zeros(len(starts), np.int64)
            kind[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            least = lowest[kind]
            # A stretch whose last holder is a window's first loses nothing by that window.
            taken = np.nonzero(confirmed[kind] & (least < high[owner]))[0]
            owner, least, starts = owner[taken], least[taken], starts[taken]
        if len(starts):
            fresh = np.concatenate([
                [True], (np.diff(taken) > 1) | (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
            ])
            begins = np.nonzero(fresh)[0]
            sizes = np.diff(np.append(begins, len(starts)))
            codes = words.codes.tolist()
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for at, size, held in zip(starts[begins].tolist(), sizes.tolist(), least[begins].tolist(), strict=True):
                automaton.add_word(tuple(codes[at:at + size + window - 1]), (size, held))
            automaton.make_automaton()
            bounds = words.offsets.tolist()
            for row, (anchor, stretch, most) in enumerate(zip(
                frame["anchor"].tolist(), frame["stretch"], high.tolist(), strict=True
            )):
                places: dict[int, int] = {}
                for end, (size, held) in automaton.iter(tuple(codes[bounds[row]:bounds[row + 1]])):
                    if held < most:
                        places.update(dict.fromkeys(range(end - window - size + 2, end - window + 2), held))
                if places:
                    out.append((anchor, stretch, list(places), list(places.values())))
        return pd.DataFrame(out, columns=["anchor", "stretch", "at", "lows"])

    return run


def _digest():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, digest, starts): first words of the windows to remove from every document.

    ``docs`` has doc_id and text; ``digest`` tells rows of one id apart by their text.
    """
    shared = Shared(docs.sparkSession)
    source = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", _digest().alias("digest"))
    listed = shared.save(
        source.mapInArrow(_anchor_rows(window), "doc_id long, digest long, anchors array<long>"), "anchors"
    )
    rows = listed.select("doc_id", "digest", F.posexplode("anchors").alias("place", "anchor"))
    recurring = shared.save(
        rows.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low != high").select(F.col("anchor").alias("recurring")),
        "recurring",
    )
    places = shared.save(
        rows.join(recurring, F.col("anchor") == F.col("recurring"))
        .groupBy("doc_id", "digest").agg(F.collect_list("place").alias("places")),
        "places",
    )
    shared.drop("anchors")
    shared.drop("recurring")
    stretches = shared.save(
        source.join(places.hint("merge"), ["doc_id", "digest"]).mapInArrow(_stretch_rows(window), STRETCHES), "stretches"
    )
    shared.drop("places")
    distinct = shared.save(
        stretches.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")),
        "distinct",
    )
    counts = distinct.groupBy(F.col("anchor").alias("_anchor")).agg(
        F.ceil(F.count(F.lit(1)) / PART_STRETCHES).cast("int").alias("parts"), F.min("low").alias("_low"),
        F.max("high").alias("_high"),
    ).where("_low != _high")
    dealt = distinct.join(counts, F.col("anchor") == F.col("_anchor")).select(
        "anchor", "stretch", "low", "high", "parts"
    ).mapInArrow(
        _part_rows(window), "anchor long, stretch binary, low long, high long, parts int, part int"
    )
    shards = max(1, -(-distinct.count() // SHARD_STRETCHES))
    shard = F.pmod(F.xxhash64("anchor", "part"), F.lit(shards))
    found = dealt.withColumn("shard", shard).groupBy("shard").applyInPandas(
        _locate(window), "anchor long, stretch binary, at array<long>, lows array<long>"
    )
    key = ["anchor", "stretch_key"]
    located = shared.save(
        found.select("anchor", F.xxhash64("stretch").alias("stretch_key"), "at", "lows"), "located"
    )
    shared.drop("distinct")
    places_of = stretches.select("doc_id", "digest", "anchor", F.xxhash64("stretch").alias("stretch_key"), "first")
    hits = places_of.join(located, key).select(
        "doc_id", "digest",
        F.transform(
            F.filter(F.arrays_zip("at", "lows"), lambda z: z["lows"] < F.col("doc_id")),
            lambda z: F.col("first") + z["at"],
        ).alias("starts"),
    ).where(F.size("starts") > 0)
    ranges = shared.save(
        hits.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("starts")).alias("starts")), "ranges"
    )
    shared.drop("stretches")
    shared.drop("located")
    return ranges


def _cut_rows(window: int, text_at: int, starts_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in each_part(batches):
            totals, removed, kept = [], [], []
            for text, starts in zip(
                part.column(text_at).to_pylist(), part.column(starts_at).to_pylist(), strict=True
            ):
                words = words_of(text)
                gone = np.zeros(len(words) + 1, np.int64)
                if starts:
                    at = np.unique(np.asarray(starts, np.int64))
                    np.add.at(gone, at, 1)
                    np.add.at(gone, np.minimum(at + window, len(words)), -1)
                mask = np.cumsum(gone)[:-1] > 0
                totals.append(len(words))
                removed.append(int(mask.sum()))
                left = words if not mask.any() else [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            columns = [part.column(k) for k in range(part.num_columns) if k != starts_at]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=[*names, "n_words", "n_removed", "kept"],
            )

    return run


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text and others) with n_words, n_removed and ``kept``: the words
    that stay, joined by one space."""
    added = ("n_words", "n_removed", "kept", "_starts")
    carried = docs.select(*[c for c in docs.columns if c not in added])
    ranges = repeated_ranges(docs.select("doc_id", "text"), window).select(
        F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), F.col("starts").alias("_starts")
    ).hint("merge")
    joined = carried.join(
        ranges, (F.col("doc_id") == F.col("_doc")) & (_digest() == F.col("_digest")), "left"
    ).select(*carried.columns, "_starts")
    schema = StructType([
        *carried.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()),
        StructField("kept", StringType()),
    ])
    return joined.mapInArrow(
        _cut_rows(window, carried.columns.index("text"), len(carried.columns), carried.columns), schema
    )
