"""Order-dependent operators against slow, plain folds, across many chunks."""

import random

import pytest

from reelgraph import config
from reelgraph.operators import dedup, skew, timestamps
from pyspark.sql import functions as F


def plain_spacing(times, spacing):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] >= spacing:
            kept.append(t)
    return kept


@pytest.mark.parametrize("spacing", [0, 1, 25, 400])
@pytest.mark.parametrize("chunk_ms", [7, 60, 1_000_000])
def test_min_spacing_matches_plain_fold(spark, rows, chunk_ms, spacing):
    rng = random.Random(3)
    points = [(v, rng.randrange(0, 3000)) for v in (0, 1, 2, None) for _ in range(400)]
    points += [(5, t) for t in range(0, 3000, 24)] + [(6, 10), (6, 2900), (7, -5), (7, -3), (7, 30)]
    df = spark.createDataFrame(points, "video_id long, timestamp_ms long")
    got = rows(timestamps.min_spacing_filter(df, spacing, chunk_ms))
    want = []
    for v in {v for v, _ in points if v is not None}:
        times = [max(0, t) for w, t in points if w == v]
        want += [(v, t) for t in plain_spacing(times, spacing)]
    assert got == sorted(want, key=repr)


def test_spacing_needs_as_many_jobs_for_any_number_of_chunks(spark):
    """A grid just too dense: every chunk depends on all before it."""
    df = spark.range(0, 40_000).select(F.lit(1).cast("long").alias("video_id"), (F.col("id") * 24).alias("timestamp_ms"))
    counts = []
    for chunk_ms in (10**7, 1000):
        tracker, name = spark.sparkContext.statusTracker(), f"spacing-{chunk_ms}"
        spark.sparkContext.setJobGroup(name, name)
        assert timestamps.min_spacing_filter(df, 25, chunk_ms).count() == 20_000
        counts.append(len(tracker.getJobIdsForGroup(name)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 1


def plain_groups(items, window, min_corr, max_bits):
    """items: (t, id, quality, vector, bits) in time order."""
    groups = []
    for item in items:
        home = None
        for group in reversed(groups):
            rep = group["rep"]
            if abs(item[0] - rep[0]) > window:
                continue
            dot = sum(a * b for a, b in zip(item[3], rep[3]))
            if dot >= min_corr and bin((item[4] ^ rep[4]) & (2**64 - 1)).count("1") <= max_bits:
                home = group
                break
        if home is None:
            groups.append({"rep": item, "ids": [item[1]]})
            continue
        home["ids"].append(item[1])
        if item[2] > home["rep"][2]:
            home["rep"] = item
    return [(g["rep"][1], tuple(g["ids"])) for g in groups]


@pytest.mark.parametrize(("chunk_ms", "lead"), [(100, 3), (90, 1), (1_000_000, 3)])
def test_near_duplicate_groups_match_plain_fold(spark, chunk_ms, lead):
    rng = random.Random(11)
    looks = [([1.0, 0.0], 0), ([1.0, 0.0], 0xFFFF), ([0.0, 1.0], -1), ([0.6, 0.8], 5)]
    data, want = [], {}
    for section in range(3):
        items = []
        for i, t in enumerate(sorted(rng.sample(range(0, 4000), 300))):
            vector, bits = rng.choice(looks)
            items.append((t, section * 1000 + i, rng.randrange(6) / 5, vector, bits))
        want[section] = plain_groups(items, 90, 0.92, 6)
        data += [(1, section, i, t, q, v, b) for t, i, q, v, b in items]
    df = spark.createDataFrame(
        data,
        "video_id long, section_index long, frame_id long, timestamp_ms long, "
        "quality_score double, unit_histogram array<double>, phash long",
    )
    limits = config.DedupLimits(90, 0.92, 6)
    got = {}
    for r in dedup.near_duplicate_groups(df, limits, chunk_ms=chunk_ms, lead_windows=lead).collect():
        group = got.setdefault(r.section_index, {}).setdefault(r.group_no, [None, []])
        group[0] = r.representative_frame_id
        group[1].append((r.member_no, r.frame_id))
    for section, groups in want.items():
        found = [
            (got[section][n][0], tuple(f for _, f in sorted(got[section][n][1])))
            for n in sorted(got[section])
        ]
        assert found == groups


@pytest.mark.parametrize("max_hamming", [0, 1, 6, 63, 64])
def test_banded_pairs_match_every_pair(spark, rows, max_hamming):
    """Bits differ at random places, the sign bit and band edges among them."""
    rng = random.Random(max_hamming)
    base = [rng.getrandbits(64) for _ in range(3)] + [0]
    frames = []
    for i in range(160):
        bits = rng.choice(base)
        for place in rng.sample(range(64), rng.choice([0, 1, 2, 6, 7, 8])):
            bits ^= 1 << place
        vector = rng.choice([[1.0, 0.0], [0.6, 0.8], [1.0, 0.0, 0.0], None])
        frames.append((1, i % 2, i, rng.randrange(0, 400), vector, bits - 2**64 if bits >= 2**63 else bits))
    frames.append((1, 0, 900, 10, [1.0, 0.0], None))
    df = spark.createDataFrame(
        frames, "video_id long, section_index long, frame_id long, timestamp_ms long, "
        "unit_histogram array<double>, phash long",
    )
    got = rows(dedup.duplicate_pairs(df, config.DedupLimits(90, 0.5, max_hamming)),
               "section_index", "left_frame_id", "right_frame_id", "hash_distance")
    want = []
    for _, s, i, t, v, h in frames:
        for _, s2, i2, t2, v2, h2 in frames:
            if h is None or h2 is None or s != s2 or (t, i) >= (t2, i2) or t2 - t > 90:
                continue
            bits = ((h ^ h2) & (2**64 - 1)).bit_count()
            alike = v and v2 and len(v) == len(v2) and sum(a * b for a, b in zip(v, v2)) >= 0.5
            if bits <= max_hamming and alike:
                want.append((s, i, i2, bits))
    assert got == sorted(want, key=repr) and (want or max_hamming == 0)


def test_no_histogram_in_the_shuffle_of_pairs(spark):
    df = spark.createDataFrame(
        [], "video_id long, section_index long, frame_id long, timestamp_ms long, "
        "unit_histogram array<double>, phash long",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dedup_plan = dedup.duplicate_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in dedup_plan.splitlines() if "Generate posexplode" in line]
    assert joins and all("unit_histogram" not in line for line in joins)


def test_borders_that_differ_run_again(spark, monkeypatch):
    """A better frame every half window keeps one group alive far beyond any lead."""
    rounds = []
    plain = dedup._same
    monkeypatch.setattr(dedup, "_same", lambda c, other: rounds.append(other) or plain(c, other))
    data = [(1, 1, k, k * 45, k / 100, [1.0, 0.0], 0) for k in range(60)] + [(1, 1, 900, 20, 0.5, [0.0, 1.0], 0)]
    df = spark.createDataFrame(
        data, "video_id long, section_index long, frame_id long, timestamp_ms long, "
        "quality_score double, unit_histogram array<double>, phash long",
    )
    limits = config.DedupLimits(90, 0.92, 6)
    got = dedup.near_duplicate_groups(df, limits, chunk_ms=270).collect()
    assert {(r.group_no, r.frame_id) for r in got} == {(1, k) for k in range(60)} | {(2, 900)}
    assert {r.member_no for r in got if r.group_no == 1} == set(range(1, 61))
    # A lead that begins inside the group finds the same representatives: nothing ran again.
    assert rounds == ["o_"]
    flat = [(1, 1, k, k * 45, 0.5, [1.0, 0.0], 0) for k in range(60)]
    again = dedup.near_duplicate_groups(spark.createDataFrame(flat, df.schema), limits, chunk_ms=270, lead_windows=1)
    assert [len([r for r in again.collect() if r.group_no == n]) for n in range(1, 21)] == [3] * 20
    assert rounds.count("w_") >= 1


def test_rank_in_key_splits_hot_keys(spark, rows):
    rng = random.Random(5)
    data = [(0 if i % 3 else i % 7, rng.randrange(20) / 10, i) for i in range(3000)]
    df = spark.createDataFrame(data, "k long, score double, i long")
    order = [F.col("score").desc(), F.col("i").asc()]
    split = rows(skew.rank_in_key(df, ["k"], order, -F.floor(F.col("score") * 3)))
    plain = rows(skew.rank_in_key(df, ["k"], order, F.lit(0)))
    assert split == plain


def test_running_max_and_offsets_do_not_depend_on_blocks(spark, rows):
    rng = random.Random(7)
    data = [(v, p, rng.randrange(100)) for v in range(3) for p in range(50)]
    df = spark.createDataFrame(data, "v long, p long, x long")
    for block in (1, 7, 1000):
        top = rows(skew.previous_and_running_max(df, ["v"], "p", F.col("x"), block))
        sums = rows(skew.offset_and_total(df, ["v"], "p", F.col("x"), block))
        for v in range(3):
            series = [x for w, _, x in data if w == v]
            for p in range(50):
                before = max(series[:p]) if p else None
                assert (v, p, series[p], max(series[: p + 1]), before) in top
                assert (v, p, series[p], sum(series), sum(series[:p])) in sums
            top_v = [r for r in top if r[0] == v]
            assert len(top_v) == 50
