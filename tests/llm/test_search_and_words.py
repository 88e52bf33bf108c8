"""Decontamination, ranked search and spelling variants against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelgraph.llm import bits, decontaminate, lexical_rank, spelling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id long, text string, extra string"
SYLLABLES = ["ba", "ce", "di", "fo", "gu", "ha"]


def terms(text):
    return TERM.findall((text or "").translate(CAPITALS))


def prose(seed, n, syllables=3):
    draw = np.random.default_rng(seed)
    return ["".join(draw.choice(SYLLABLES, draw.integers(1, syllables + 1))) for _ in range(n)]


def odd_texts():
    passage = " ".join(prose(1, 24))
    return [
        None, "", " \x00\x7f -- ", "one", passage, "Head " + passage.upper() + ". Tail!", passage + " " + passage,
        " ".join(prose(2, 4000)) + " " + passage + " " + " ".join(prose(3, 4000)), "x" * 50_000 + " " + passage,
        "café ÀÉ naïve 中文 words, 12 and 3.4", " ".join(passage.split()[5:14]), " ".join(passage.split()[5:15]),
        "one two three one two three", passage, "a\x85b c", "two words",
    ]


ODD_ITEMS = [
    (1, " ".join(prose(1, 24)), "x"), (2, "two words", "x"), (3, "One", "x"), (4, None, "x"), (5, " ... ", "x"),
    (None, "three one", "x"), (10, " ".join(prose(1, 24)), "x"), (7, "never seen here at all", "x"),
    (2, "words two", "x"), (6, "café àÉ", "x"), (8, " ".join(prose(9, 40)), "x"), (11, "two two words words two", "x"),
]


def clashing(documents, texts):
    """Documents with columns named like those that operators make, one id null, one twice."""
    rows = [*enumerate(texts), (None, "two words of no id"), (3, "one")]
    names = ("row", "n", "n_words", "places", "shingle", "salt", "number", "shard", "terms", "word", "items", "score", "rank")
    frame = documents(rows)
    for name in names:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame, rows


# 11 -----------------------------------------------------------------------------


def plain_hits(text, windows):
    words, covered, found = terms(text), set(), set()
    for size in {k for k, _ in windows}:
        for at in range(len(words) - size + 1):
            ids = windows.get((size, tuple(words[at:at + size])))
            if ids:
                found |= ids
                covered.update(range(at, at + size))
    return len(words), len(covered), sorted(found), covered


def plain_windows(items, window=10):
    windows = defaultdict(set)
    for item_id, text, _ in items:
        words = terms(text)
        size = min(window, len(words))
        if item_id is not None and size:
            for at in range(len(words) - size + 1):
                windows[size, tuple(words[at:at + size])].add(str(item_id))
    return windows


@pytest.mark.parametrize(("window", "shingle"), [(10, 3), (10, 1), (4, 4), (2, 3)])
def test_windows_of_items_in_documents(spark, documents, window, shingle):
    docs, rows = clashing(documents, odd_texts())
    items = spark.createDataFrame(ODD_ITEMS, ITEMS)
    windows = plain_windows(ODD_ITEMS, window)
    got = decontaminate.decontaminate(docs, items, window, shingle).collect()
    seen = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got)
    want = Counter((i, *plain_hits(t, windows)[:2], tuple(plain_hits(t, windows)[2])) for i, t in rows)
    assert seen == want and any(r.n_hit for r in got)
    for r in got:
        inside = {p for s in r.spans for p in range(s.start, s.end)}
        assert len(inside) == r.n_hit == sum(s.end - s.start for s in r.spans)


def test_only_prefix_shingles_are_joined(spark, documents):
    """A window is found by its rarest shingle; of documents that hold others nothing is kept."""
    common, rare = "aa bb cc dd ee ff gg hh ii", "zz"
    docs = documents([(k, common) for k in range(50)] + [(99, common + " " + rare)])
    windows = spark.createDataFrame([(1, f"{common} {rare}", "")], ITEMS).select("item_id", "text").mapInArrow(
        decontaminate._window_rows(10, 3), "item_id long, words array<string>, shingles array<long>"
    ).withColumn("phrase", F.array_join("words", " "))
    table = bits.bit_table(windows.select(F.explode("shingles").alias("s")), "s")
    counts = docs.select("text").mapInArrow(decontaminate._count_rows(table, [3]), "shingle long, n long")
    prefix = decontaminate._prefixes(windows, counts.groupBy("shingle").agg(F.sum("n").alias("n"))).collect()
    assert [r.place for r in prefix] == [7]
    wanted = bits.bit_table(spark.createDataFrame([(prefix[0].shingle,)], "s long"), "s")
    places = docs.select("doc_id", "text").mapInArrow(
        decontaminate._place_rows(wanted, [3], 10), decontaminate.PLACES.format(id="long")
    ).where(F.size("places") > 0).collect()
    assert [r.doc_id for r in places] == [99]


def test_a_false_match_of_the_prefix_is_no_hit(spark, documents):
    """Same rarest shingle, other words around it; and too near to the edges of the text."""
    item = " ".join(f"w{k}" for k in range(10))
    texts = [item, "v0 " + " ".join(f"w{k}" for k in range(1, 10)), " ".join(f"w{k}" for k in range(1, 10)), item[:-1]]
    got = decontaminate.decontaminate(documents(list(enumerate(texts))), spark.createDataFrame([(1, item, "")], ITEMS))
    assert {r.doc_id: r.n_hit for r in got.collect()} == {0: 10, 1: 0, 2: 0, 3: 0}


def test_decontamination_of_empty_tables(spark, documents):
    items, none = spark.createDataFrame(ODD_ITEMS, ITEMS), spark.createDataFrame([], ITEMS)
    assert decontaminate.decontaminate(documents([]), items).count() == 0
    got = decontaminate.decontaminate(documents([(1, "two words"), (2, None)]), none).collect()
    assert {(r.doc_id, r.n_words, r.n_hit) for r in got} == {(1, 2, 0), (2, 0, 0)}


def test_words_of_whole_buffers():
    """Hashes depend on the words alone: not on their place, nor on the slice they lie in."""
    finder = bits.ByteWords(decontaminate._lower())
    long = "q" * (bits.SLICE + 5) + " Tail of it " + "r s " * (bits.SLICE // 3)
    texts = ["one Two", None, "", "two", "one", long, "é é", "x" * (3 * bits.SLICE)]
    spelled, hashes = [], {}
    for _, cuts, data, starts, ends, found in finder.of(pa.array(texts)):
        for s, e, h in zip(starts.tolist(), ends.tolist(), found.tolist(), strict=True):
            word = data[s:e].tobytes().lower()
            assert hashes.setdefault(word, h) == h
            spelled.append(word.decode())
            assert not any(s < c < e for c in cuts.tolist())
    assert spelled == [w for t in texts for w in terms(t)]
    assert len(set(hashes.values())) == len(hashes)


# 12 -----------------------------------------------------------------------------


def plain_scores(rows, items):
    docs = [(i, Counter(terms(t))) for i, t in rows if i is not None]
    lengths = [sum(c.values()) for _, c in docs]
    count, total = sum(n > 0 for n in lengths), sum(lengths)
    held = Counter(t for _, c in docs for t in c)
    asked = defaultdict(Counter)
    for item, text, *_ in items:
        if item is not None:
            asked[item].update(terms(text))
    out = {}
    for item, query in asked.items():
        scored = []
        for (doc, counts), n in zip(docs, lengths, strict=True):
            score = sum(
                r * math.floor(1000 * math.log((2 * count + 2) / (2 * held[t] + 1)))
                * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * (75 + 25 * n * count // total)))
                for t, r in query.items() if counts[t]
            )
            if score > 0:
                scored.append((-score, doc))
        out[item] = [(d, -s) for s, d in sorted(scored)]
    return out


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(lexical_rank, "SHARD_DOCS", 24)
    monkeypatch.setattr(lexical_rank, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(lexical_rank, "FIRST", 3)


def ranked(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.item_id, r["rank"])):
        assert r["rank"] == len(out[r.item_id]) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return dict(out)


@pytest.mark.parametrize("k", [1, 5, 20])
def test_ranks_equal_plain_scores(spark, documents, small_shards, k):
    texts = odd_texts() + [" ".join(prose(100 + s, 5 + s % 60, 2)) for s in range(120)] + ["ba ce", "ba ce", "ce ba"]
    docs, rows = clashing(documents, texts)
    items = ODD_ITEMS + [(20 + s, " ".join(prose(900 + s, 12, 2)), "") for s in range(8)]
    got = ranked(lexical_rank.search(docs, spark.createDataFrame(items, ITEMS), k).collect())
    want = {i: found[:k] for i, found in plain_scores(rows, items).items() if found}
    assert got == want and max(map(len, want.values())) == k


def test_search_of_empty_tables(spark, documents):
    items, none = spark.createDataFrame(ODD_ITEMS, ITEMS), spark.createDataFrame([], ITEMS)
    for docs, asked in ((documents([]), items), (documents([(1, None), (2, "..")]), items), (documents([(1, "one")]), none)):
        found = lexical_rank.search(docs, asked)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def lists_of(tfs, damped):
    """Lists from a matrix of occurrences, one row a term."""
    terms_at, docs = np.nonzero(tfs)
    return lexical_rank.Lists(
        np.arange(tfs.shape[1]), damped, docs.astype(np.int64), terms_at.astype(np.int64), tfs[terms_at, docs].astype(np.int64)
    )


def test_best_positions_meet_every_tie():
    draw = np.random.default_rng(7)
    for trial in range(60):
        tfs = draw.integers(0, 3, (4, 200)) * (draw.random((4, 200)) < draw.random((4, 1)))
        damped = draw.integers(75, 78, 200)
        lists, weights = lists_of(tfs, damped), draw.integers(0, 4, 4)
        gains = (10 ** 9 * tfs) // (1000 * tfs + 12 * damped) * weights[:, None]
        score = gains.sum(axis=0)
        order = np.lexsort((np.arange(200), -score))
        want = [(d, score[d]) for d in order[:10].tolist() if score[d] > 0]
        for floor in (1, int(score[order[9]]) or 1):
            docs, scores, _ = lists.best(np.arange(4), weights, 10, floor)
            assert [(d, s) for d, s in zip(docs.tolist(), scores.tolist(), strict=True) if s > 0] == want, trial


def test_best_positions_stop_early():
    """The best documents lead both lists in opposite order. Direct accesses mark the other
    list's places, so reading ends at half the depth that last-read positions would need."""
    n = 20_000
    tfs = np.ones((2, n), np.int64)
    tfs[0, :32], tfs[1, :32] = np.arange(40, 72), np.arange(71, 39, -1)
    lists = lists_of(tfs, np.full(n, 75))
    docs, scores, depth = lists.best(np.arange(2), np.ones(2, np.int64), 20, 1)
    assert depth == lexical_rank.DEPTH and len(docs) == 20
    _, _, to_the_end = lists_of(np.ones((2, n), np.int64), np.full(n, 75)).best(np.arange(2), np.ones(2, np.int64), 20, 1)
    assert to_the_end == n or to_the_end > n // 2


# 13 -----------------------------------------------------------------------------


def plain_words(rows, least_length=6, least_count=5, noise=199):
    total = Counter()
    for doc, text in rows:
        for run, n in Counter(r.translate(CAPITALS) for r in RUN.findall(text or "")).items():
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += n
    return {w: n for w, n in total.items() if n >= least_count and len(w) >= least_length}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(words):
    form = {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, others in near.items():
        if others:
            top = min(others, key=lambda v: (-words[v], v))
            if words[top] >= 5 * words[w]:
                form[w] = top
    rows = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return rows


def misspelt(seed, words):
    draw = np.random.default_rng(seed)
    out = []
    for word in words:
        at, kind = int(draw.integers(0, len(word))), int(draw.integers(0, 4))
        letter = "aéÿÀxz"[int(draw.integers(0, 6))]
        out.append([word, word[:at] + word[at + 1:], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1:]][kind])
    return out


@pytest.fixture
def words_table(documents):
    base = ["banana", "bananas", "Strasse", "élève", "elevation", "aaaaaa", "aaaaaaa", "abababab", "difoguha", "ÀÉÎÕÜß"]
    texts = [None, "", "short x", "中文 банан \x00", "×÷×÷×÷ ×÷×÷×÷"]
    for seed in range(60):
        texts.append(" ".join(misspelt(seed, base * 6)) + "-" + " ".join(base[:4] * 3))
    texts += ["levels " * 6, "levelz " * 40, "levelzz " * 250, "levelzzz " * 1500]
    return clashing(documents, texts)


@pytest.mark.parametrize("noise", [199, 3, 0])
def test_variants_equal_plain_ones(words_table, noise):
    docs, rows = words_table
    got = spelling.variants(docs, noise=noise).collect()
    want = plain_variants(plain_words(rows, noise=noise))
    assert len(got) == len(want) and {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert noise != 0 or any(r.root not in (r.word, r.form) for r in got)


def test_hot_chunks_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART_WORDS", 7)
    draw = np.random.default_rng(3)
    words = sorted({"same" + "".join(draw.choice(list("abc"), 4)) for _ in range(70)} | {"same" + "abca" + c for c in "abc"})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = [(r.a, r.b) for r in spelling.near_pairs(frame).collect()]
    want = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_two_chunks_find_every_single_edit(spark):
    """Words of 2 to 9 letters over two letters: repeats inside words, edits at every place."""
    draw = np.random.default_rng(5)
    words = sorted({"".join(draw.choice(["a", "é"], draw.integers(2, 10))) for _ in range(400)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = [(r.a, r.b) for r in spelling.near_pairs(frame).collect()]
    want = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_variants_of_an_empty_table(documents):
    assert spelling.variants(documents([])).count() == 0
    with pytest.raises(ValueError, match="factor"):
        spelling.variants(documents([]), factor=1)
