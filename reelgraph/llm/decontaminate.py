"""Benchmark decontamination by a prefix-filtered set join.

Records. An item gives its windows of ``window`` consecutive words; a shorter item is one
window. A window is held as the set of its shingles of ``shingle`` words (of all its words
if it has fewer), each with its place.

Order. Shingles are ordered by rarity: their number of occurrences in all documents, which
an aggregate over the whole corpus counts. For that the items' shingles go to the tasks as
a bit table of fixed size.

Prefix. A set of m shingles of which a document must hold t needs its m - t + 1 rarest ones
in the join. Containment is exact here, t = m, so the prefix is the rarest shingle alone;
a window with a shingle that no document has is ruled out before any join.

Join. Documents give the places of prefix shingles only, with the words around them. They
meet the windows on the shingle, salted because one benchmark passage may lie in a third of
all documents. Length bound: a document has at least the window's words. Positional bound:
the window, laid so that the shingles coincide, begins and ends inside the document.

Verification. The document's words of that item-sized window equal the window word for word.

Defined cases: null and empty texts have no words; texts are read whole; a word is lower-cased
in A-Z only; items with a null id take no part, items without words give no window, several rows
of one item id count as one item; rows of one doc_id, or with a null one, are documents of
their own; other columns are not read; empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.llm.bits import ByteWords, bit_table, may_hold, shingle_hashes
from reelgraph.llm.common import Shared
from reelgraph.llm.word_scores import each_part

WINDOW = 10
SHINGLE = 3
#: Parts into which the places of one shingle are dealt.
SALTS = 64
TEXTS = 512


def _lower() -> np.ndarray:
    """Digits, letters in lower case and all bytes of other characters; 0 ends a word."""
    table = np.arange(256, dtype=np.uint8)
    table[:0x30] = table[0x3A:0x41] = table[0x5B:0x61] = table[0x7B:0x80] = 0
    table[0x41:0x5B] += 0x20
    return table


def _spelled(words: ByteWords, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    return [words.lower[data[s:e]].tobytes().decode("utf-8", "replace") for s, e in zip(starts, ends, strict=True)]


def _window_rows(window: int, shingle: int):
    """Rows (item_id, words, shingles) of the windows of items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ByteWords(_lower())
        for part in each_part(batches, TEXTS):
            owner, spelled, shingles = [], [], []
            for first, cuts, data, starts, ends, hashes in words.of(part.column(1)):
                bounds = np.searchsorted(starts, cuts)
                for k in range(len(cuts) - 1):
                    own = slice(bounds[k], bounds[k + 1])
                    text, coded = _spelled(words, data, starts[own], ends[own]), hashes[own]
                    size = min(window, len(text))
                    for at in range(len(text) - size + 1) if size else ():
                        owner.append(first + k)
                        spelled.append(text[at:at + size])
                        shingles.append(shingle_hashes(coded[at:at + size], min(shingle, size)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner, pa.int64())), pa.array(spelled, pa.list_(pa.string())),
                 pa.array(shingles, pa.list_(pa.int64()))],
                names=["item_id", "words", "shingles"],
            )

    return run


def _matches(words: ByteWords, table: np.ndarray, lengths: list[int], texts: pa.Array):
    """Runs of texts with, per shingle length, the word numbers whose shingles pass the table."""
    for first, cuts, data, starts, ends, hashes in words.of(texts):
        bounds = np.searchsorted(starts, cuts)
        found = []
        for n in lengths:
            coded = shingle_hashes(hashes, n)
            at = np.flatnonzero(may_hold(table, coded))
            text = np.searchsorted(bounds, at, side="right") - 1
            inside = at + n <= bounds[text + 1]
            found.append((at[inside], text[inside], coded[at[inside]]))
        yield first, data, starts, ends, bounds, found


def _count_rows(bits: bytes, lengths: list[int]):
    """Rows (shingle, n) of the occurrences in a run of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = ByteWords(_lower()), np.frombuffer(bits, np.uint8)
        for part in each_part(batches, TEXTS):
            for *_, found in _matches(words, table, lengths, part.column(0)):
                shingles, n = np.unique(np.concatenate([f[2] for f in found]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingles.view(np.int64)), pa.array(n, pa.int64())], names=["shingle", "n"]
                )

    return run


PLACES = (
    "doc_id {id}, n_words long, "
    "places array<struct<shingle: long, at: long, first: long, around: array<string>>>"
)


def _place_rows(bits: bytes, lengths: list[int], window: int):
    """Every document with its number of words and the places of prefix shingles."""
    kind = pa.struct([
        ("shingle", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("around", pa.list_(pa.string())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = ByteWords(_lower()), np.frombuffer(bits, np.uint8)
        for part in each_part(batches, TEXTS):
            totals = np.zeros(part.num_rows, np.int64)
            places: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for first, data, starts, ends, bounds, found in _matches(words, table, lengths, part.column(1)):
                totals[first:first + len(bounds) - 1] = np.diff(bounds)
                for at, text, coded in found:
                    for place, k, shingle in zip(at.tolist(), text.tolist(), coded.view(np.int64).tolist(), strict=True):
                        low, high = int(bounds[k]), int(bounds[k + 1])
                        begin, stop = max(low, place - window + 1), min(high, place + window)
                        places[first + k].append({
                            "shingle": shingle, "at": place - low, "first": begin - low,
                            "around": _spelled(words, data, starts[begin:stop], ends[begin:stop]),
                        })
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(totals), pa.array(places, pa.list_(kind))],
                names=["doc_id", "n_words", "places"],
            )

    return run


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, words, shingle, place): each window that may occur with its rarest shingle."""
    shingles = windows.select("phrase", "words", F.posexplode("shingles").alias("place", "shingle"))
    known = counts.select(F.col("shingle").alias("counted"), F.col("n").alias("occurs"))
    ordered = shingles.join(known, F.col("shingle") == F.col("counted"), "left")
    return ordered.groupBy("phrase").agg(
        F.first("words").alias("words"),
        F.min(F.struct(F.coalesce("occurs", F.lit(0)).alias("occurs"), "shingle", "place")).alias("rarest"),
    ).where("rarest.occurs > 0").select("phrase", "words", "rarest.shingle", "rarest.place")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of every document.

    ``docs`` has doc_id and text, ``items`` item_id and text. ``spans`` are the word ranges
    that occurrences of windows cover, ends exclusive, in order and apart; ``n_hit`` their
    words; ``items`` the ids of the items with a window there, sorted as strings.
    """
    shared = Shared(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    listed = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string"), "text")
    of_items = shared.save(
        listed.mapInArrow(_window_rows(window, shingle), "item_id string, words array<string>, shingles array<long>")
        .withColumn("phrase", F.array_join("words", " ")),
        "windows",
    )
    windows = of_items.select("phrase", "words", "shingles").dropDuplicates(["phrase"])
    lengths = [r.n for r in of_items.select(F.least(F.size("words"), F.lit(shingle)).alias("n")).distinct().collect()]
    source = docs.select("doc_id", "text")
    bits = bit_table(of_items.select(F.explode("shingles").alias("shingle")), "shingle")
    counts = source.select("text").mapInArrow(_count_rows(bits, sorted(lengths)), "shingle long, n long") if lengths \
        else docs.sparkSession.createDataFrame([], "shingle long, n long")
    prefixes = shared.save(
        _prefixes(windows, counts.groupBy("shingle").agg(F.sum("n").alias("n"))), "prefixes"
    )
    wanted = bit_table(prefixes, "shingle")
    # Numbered once written: rows of one doc_id stay apart.
    found = shared.save(
        source.mapInArrow(_place_rows(wanted, sorted(lengths), window), PLACES.format(id=id_type))
        .withColumn("row", F.monotonically_increasing_id()),
        "places",
    )
    places = found.where(F.size("places") > 0).select(
        "row", "n_words", F.inline("places")
    ).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    dealt = prefixes.select(
        "phrase", "words", F.col("shingle").alias("rarest"), "place", F.size("words").cast("long").alias("size"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("part"),
    )
    start = F.col("at") - F.col("place")
    occurs = places.join(dealt, (F.col("shingle") == F.col("rarest")) & (F.col("salt") == F.col("part"))).where(
        (F.col("n_words") >= F.col("size")) & (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    ).where(
        F.slice("around", (start - F.col("first") + 1).cast("int"), F.col("size").cast("int")) == F.col("words")
    ).select("row", "phrase", start.alias("start"), (start + F.col("size")).alias("end"))
    hits = shared.save(occurs, "hits")

    earlier = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.select("row", "start", "end").distinct().withColumn("reach", reach).withColumn(
        "opens", F.coalesce(F.col("start") > F.col("reach"), F.lit(True)).cast("int")
    ).withColumn("span", F.sum("opens").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    spans = opened.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy(
        F.col("row").alias("hit_row")
    ).agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
    named = hits.select("row", "phrase").distinct().join(
        of_items.select("item_id", F.col("phrase").alias("whole")).distinct(), F.col("phrase") == F.col("whole")
    ).groupBy(F.col("row").alias("item_row")).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return found.select("row", "doc_id", "n_words").join(
        spans, F.col("row") == F.col("hit_row"), "left"
    ).join(named, F.col("row") == F.col("item_row"), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
