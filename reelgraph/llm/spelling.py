"""Spelling variants: words one edit apart, grouped under the commonest form.

Counting. Tasks count the runs of letters of whole texts; Spark adds the counts up.

Join. With an asymmetric scheme the shorter word of a pair (of equal lengths the smaller)
contributes two disjoint chunks, its first and its second q letters with q half its length.
The longer word contributes all its positional grams of that q that lie within one place of
a chunk. One inserted, deleted or replaced letter touches at most one of two disjoint
chunks; the other is a gram of the longer word, moved by one place at most. Words meet on
(length, chunk number, chunk). A pair is taken where its first common chunk meets, so none
comes twice, and is verified with a bounded edit distance.

Hot chunks. A chunk that many words share is dealt into parts of ``PART_WORDS`` words; the
grams go to each of its parts.

Roots. A word's form is its near word of largest count, if that is large enough. Counts
grow by that factor along a chain, so its length is bounded by a logarithm of the largest
count, and pointer doubling ends after a number of rounds known beforehand.

Defined cases: null and empty texts have no words; texts are read whole; A-Z alone is
lower-cased; a null doc_id is written as an empty text before the colon of the noise rule;
rows of one doc_id count as often as they come; other columns are not read; an empty table
gives no rows; ties go to the smallest word by code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import Shared
from reelgraph.llm.word_scores import each_part

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form has at least so many times the occurrences of its variant.
FACTOR = 5
#: One run in so many (by a checksum) loses a letter; 0 for none.
NOISE = 199
#: Words of one part of a chunk.
PART_WORDS = 2000
#: Words a task counts before it hands them on.
COUNT_TABLE = 500_000


def _count_rows(least: int, noise: int):
    """Rows (word, n). One byte is one code point here; other characters become a byte that
    is no letter."""
    run_of = re.compile(rb"[A-Za-z\xC0-\xFF]{%d,}" % least)

    def changed(doc: bytes, words: list[bytes]) -> Iterator[tuple[bytes, int]]:
        start = zlib.crc32(doc + b":")
        for word in words:
            mark = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
            if mark % noise == 0:
                yield word, mark % len(word)

    def rows(totals: dict[bytes, int]) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in totals]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[bytes] = Counter()
        for part in each_part(batches):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                counts = Counter(run_of.findall(text.encode("latin-1", "replace").lower()))
                for word, at in list(changed((doc or "").encode(), list(counts)) if noise else ()):
                    n = counts.pop(word)
                    shorter = word[:at] + word[at + 1:]
                    if len(shorter) >= least:
                        totals[shorter] += n
                totals.update(counts)
            if len(totals) > COUNT_TABLE:
                yield rows(totals)
                totals = Counter()
        yield rows(totals)

    return run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(
        _count_rows(least_length, noise), "word string, n long"
    )
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words one edit apart, once, the shorter word first.

    ``words`` has word and n, each word once, of two letters or more.
    """
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    chunks = words.select(
        F.col("word").alias("a"), F.col("n").alias("a_n"), size.alias("size"), half.alias("q"),
        F.posexplode(F.array(F.substring("word", F.lit(1), half), F.substring("word", half + 1, half))).alias("no", "chunk"),
    )
    hot = chunks.groupBy(F.col("size").alias("h_size"), F.col("no").alias("h_no"), F.col("chunk").alias("h_chunk")).agg(
        F.ceil(F.count(F.lit(1)) / PART_WORDS).cast("int").alias("parts")
    ).where("parts > 1")

    def with_parts(rows: DataFrame) -> DataFrame:
        same = (F.col("size") == F.col("h_size")) & (F.col("no") == F.col("h_no")) & (F.col("chunk") == F.col("h_chunk"))
        return rows.join(hot, same, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("h_size", "h_no", "h_chunk")

    dealt = with_parts(chunks).withColumn("part", F.pmod(F.hash("a"), F.col("parts"))).drop("parts")

    # A longer word meets words of its own length and of one letter less.
    longer = words.select(
        F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.array(size, size - 1)).alias("size")
    ).where(F.col("size") >= 2).withColumn("q", F.floor(F.col("size") / 2).cast("int"))

    def grams(places: list) -> F.Column:
        held = F.filter(F.array(*places), lambda p: (p >= 0) & (p + F.col("q") <= F.length("b")))
        return F.array_distinct(F.transform(held, lambda p: F.substring(F.col("b"), p + 1, F.col("q"))))

    q = F.col("q")
    near = longer.select(
        "b", "b_n", "size",
        F.posexplode(F.array(grams([F.lit(0), F.lit(1)]), grams([q - 1, q, q + 1]))).alias("no", "grams"),
    ).select("b", "b_n", "size", "no", F.explode("grams").alias("chunk"))
    spread = with_parts(near).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = dealt.join(spread, ["size", "no", "chunk", "part"])
    first = F.substring("a", F.lit(1), q)
    earlier = (F.substring(F.col("b"), F.lit(1), q) == first) | (F.substring(F.col("b"), F.lit(2), q) == first)
    ordered = (F.length("b") > F.length("a")) | (F.col("a") < F.col("b"))
    return met.where(ordered).where((F.col("no") == 0) | ~earlier).where(
        F.levenshtein("a", "b", 1) == 1
    ).select("a", "a_n", "b", "b_n")


def variants(docs: DataFrame, factor: int = FACTOR, **rule: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary(docs, **rule)``."""
    if factor < 2:
        raise ValueError("chains of forms end only if counts grow: factor must be 2 or more")
    shared = Shared(docs.sparkSession)
    words = shared.save(vocabulary(docs, **rule), "words")
    pairs = shared.save(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("of"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select("b", "a", "a_n")
    )
    best = both.groupBy("of").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("word"))).alias("top"),
    )
    strong = -F.col("top.order") >= factor * F.col("n")
    formed = shared.save(
        words.join(best, F.col("word") == F.col("of"), "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, F.col("top.word")).alias("form"), F.when(strong, -F.col("top.order")).alias("form_n"),
        ),
        "formed",
    )
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    longest = 1
    while factor ** longest <= most:
        longest += 1
    for number in range(longest.bit_length()):
        onward = roots.select(F.col("word").alias("step"), F.col("root").alias("onward"))
        roots = shared.save(
            roots.join(onward, F.col("root") == F.col("step"), "left").select(
                "word", F.coalesce("onward", "root").alias("root")
            ),
            f"roots{number}",
        )
    ends = roots.select(F.col("word").alias("variant"), "root")
    return formed.join(ends, F.col("word") == F.col("variant"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
