"""Window joins against every pair, over windows of all lengths."""

import random

import pytest

from reelgraph.operators import intervals

FRAMES = "video_id long, frame_id long, timestamp_ms long"
SECTIONS = "video_id long, section_index long, start_ms long, end_ms long"


def tables(seed):
    rng = random.Random(seed)
    frames = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randrange(0, 20_000)) for i in range(300)]
    sections = []
    for n in range(60):
        start = rng.randrange(0, 20_000)
        length = rng.choice([-50, 0, 1, 9, 10, 11, 160, 161, 2_000, 18_000, 10**9])
        sections.append((rng.choice([1, 2, 2, 3]), n, start, start + length))
    sections += [(1, 100, None, 50), (4, 101, 0, 10**6)]
    # Windows that touch in one point, and one inside another.
    sections += [(3, 102, 100, 200), (3, 103, 200, 300), (3, 104, 120, 130)]
    return frames, sections


def window(start, end, pad, null_window):
    if null_window == "strict":
        start = 0 if start is None else start
        end = start if end is None else end
        return max(0, start - pad), end + pad
    if start is None or end is None or end <= start:
        return None
    return max(0, start - pad), end + pad


@pytest.mark.parametrize("null_window", ["all", "strict"])
@pytest.mark.parametrize("bucket_ms", [10, 600_000])
def test_frames_in_sections_match_every_pair(spark, rows, bucket_ms, null_window):
    frames, sections = tables(1)
    got = rows(intervals.frames_in_sections(
        spark.createDataFrame(frames, FRAMES), spark.createDataFrame(sections, SECTIONS), 7, null_window, bucket_ms
    ), "section_index", "frame_id")
    want = []
    for v, n, start, end in sections:
        w = window(start, end, 7, null_window)
        want += [(n, i) for u, i, t in frames if u == v and (w is None or w[0] <= t <= w[1])]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("bucket_ms", [10, 600_000])
@pytest.mark.parametrize("drop_whole", [True, False])
def test_relevant_frames_come_once(spark, rows, bucket_ms, drop_whole):
    frames, sections = tables(2)
    if drop_whole:
        sections = [s for s in sections if window(s[2], s[3], 3, "all") and s[3] - s[2] < 1000]
    got = rows(intervals.relevant_frames(
        spark.createDataFrame(frames, FRAMES), spark.createDataFrame(sections, SECTIONS), 3, bucket_ms
    ), "frame_id")
    want = set()
    for v, _, start, end in sections:
        w = window(start, end, 3, "all")
        want |= {(i,) for u, i, t in frames if u == v and (w is None or w[0] <= t <= w[1])}
    assert got == sorted(want, key=repr)


def test_overlapping_sentences_match_every_pair(spark, rows):
    rng = random.Random(5)
    spans = lambda n, lengths: [
        (rng.choice([1, 1, 2]), i, s, s + rng.choice(lengths)) for i in range(n) for s in [rng.randrange(0, 4000) / 8]
    ]
    sentences, windows = spans(200, [0.0, 0.5, 3.0, 40.0]), spans(60, [0.0, 1.0, 29.5, 30.0, 400.0])
    got = rows(intervals.segments_overlapping(
        spark.createDataFrame(sentences, "video_id long, sentence_index long, start_seconds double, end_seconds double"),
        spark.createDataFrame(windows, "video_id long, section_index long, start_seconds double, end_seconds double"), 3.0,
    ), "section_index", "sentence_index")
    want = [(n, i) for v, n, a, z in windows for u, i, s, e in sentences if u == v and e >= a and s <= z]
    assert got == sorted(want, key=repr)


def test_wide_windows_are_few_rows_and_hot_videos_many_keys(spark):
    """A window of any length touches three buckets at most; a wide bucket has many parts."""
    windows = spark.createDataFrame([(1, 0, 10**k) for k in range(3, 12)], "video_id long, low long, high long")
    placed = intervals._placed(windows, "low", "high", 1000)
    counts = placed.groupBy("high").agg({"_b": "approx_count_distinct", "_part": "max"}).collect()
    assert all(r["approx_count_distinct(_b)"] <= 3 for r in counts)
    assert max(r["max(_part)"] for r in counts) == intervals.PARTS - 1


def test_no_windows(spark):
    frames, _ = tables(1)
    none = spark.createDataFrame([], SECTIONS)
    df = spark.createDataFrame(frames, FRAMES)
    assert intervals.frames_in_sections(df, none).count() == 0 and intervals.relevant_frames(df, none).count() == 0
