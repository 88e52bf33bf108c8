"""Exact small inputs per operator."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.functions import geometry, responses, text
from reelgraph.functions.geometry import Box
from reelgraph.operators import (
    catalogue,
    documents,
    intervals,
    quality,
    ranking,
    scenes,
    scoring,
    timestamps,
    transcript,
    usage,
)
from reelgraph.sources import artifacts, images


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_candidate_timestamps(spark, rows):
    videos = spark.createDataFrame([(1, 11000), (2, 0)], "video_id long, duration_ms long")
    scenes_df = spark.createDataFrame(
        [(1, 3200), (1, 7800), (1, 15000)], "video_id long, timestamp_ms long"
    )
    got = rows(timestamps.candidate_timestamps(videos, scenes_df))
    assert [t for v, t in sorted(got) if v == 1] == [0, 2000, 3200, 4000, 6000, 7800, 10000]
    assert [t for v, t in got if v == 2] == [0]


@pytest.mark.parametrize("pad, want", [(0, {3, 4}), (2000, {2, 3, 4, 5})])
def test_section_window(spark, pad, want):
    frames = spark.createDataFrame(
        [(1, i + 1, int(t * 1000)) for i, t in enumerate([7.9, 8, 10, 14, 16, 16.1])],
        "video_id long, frame_id long, timestamp_ms long",
    )
    sections = spark.createDataFrame(
        [(1, 1, 10000, 14000)], "video_id long, section_index long, start_ms long, end_ms long"
    )
    got = intervals.frames_in_sections(frames, sections, pad)
    assert {r.frame_id for r in got.collect()} == want


def test_unusable_window_covers_the_video(spark):
    frames = spark.createDataFrame(
        [(1, 1, 0), (1, 2, 10**9)], "video_id long, frame_id long, timestamp_ms long"
    )
    sections = spark.createDataFrame(
        [(1, 1, None, None), (1, 2, 500, 400), (1, 3, 0, 10**9)],
        "video_id long, section_index long, start_ms long, end_ms long",
    )
    assert intervals.frames_in_sections(frames, sections, 0).count() == 6
    assert intervals.frames_in_sections_strict(frames, sections).count() == 2 + 1
    assert intervals.relevant_frames(frames, sections, 0).count() == 2


def test_border(spark):
    boxes = [(10.0, 10.0, 90.0, 90.0), (0.0, 10.0, 50.0, 50.0), (10.0, 10.0, 100.0, 50.0)]
    got = [
        one(spark, geometry.touches_border(Box(*map(F.lit, b)), F.lit(100), F.lit(100)))
        for b in boxes
    ]
    assert got == [False, True, True]


@pytest.mark.parametrize(
    "value, number, want",
    [("90", True, 90.0), ("150000", True, 150.0), ("150000", False, 150000.0),
     ("01:02:03", False, 3723.0), ("2:30", False, 150.0), ("x", False, None), ("", False, None)],
)
def test_parse_seconds(spark, value, number, want):
    assert one(spark, text.parse_seconds(F.lit(value), number)) == want


@pytest.mark.parametrize(
    "seconds, want", [(0.5, "00:00"), (1.5, "00:02"), (3600.0, "01:00:00"), (-4.0, "00:00")]
)
def test_format_timestamp(spark, seconds, want):
    assert one(spark, text.format_timestamp(F.lit(seconds))) == want


def test_text_helpers(spark):
    assert one(spark, text.format_duration(F.lit(0))) == "未知"
    assert one(spark, text.normalize_label(F.lit("  舵机 "))) == "servo"
    assert one(spark, text.normalize_label(F.lit("Robot-Arm_Base"))) == "robot_arm_base"
    assert one(spark, text.normalize_id(F.lit(" Fixed -- To! "))) == "fixed_to"
    assert one(spark, text.collapse_ws(F.lit("a　 b\n\tc "))) == "a b c"
    assert one(spark, text.tokenize(F.lit("Wire, ab 舵机。WIRE screws"))) == [
        "wire", "servo", "screws",
    ]
    assert one(spark, text.frame_type(F.lit("安装完成"))) == "operation_frame"
    assert one(spark, text.frame_type(F.lit("其他"))) == "overview_frame"
    assert one(spark, text.safe_filename(F.lit("a/../b c.PNG"), F.lit(3))) == "b_c.png"
    assert one(spark, text.safe_filename(F.lit("x/。.gif"), F.lit(3))) == "frame_00003.jpg"
    assert one(spark, text.frame_timestamp_from_name(F.lit("f/000042000.jpg"))) == 42000
    assert one(spark, text.frame_timestamp_from_name(F.lit("cover.jpg"))) == 0
    assert one(spark, text.media_type(F.lit(".MP4"))) == "video/mp4"
    assert one(spark, text.media_type(F.lit(".xyz"))) == "application/octet-stream"
    clipped = one(spark, text.summarize(F.lit("x" * 2000), 80))
    assert len(clipped) == 83 and clipped.endswith("...")
    assert one(spark, text.clamp(F.lit(None).cast("double"), 0, 1)) is None


def test_black_frame_fails(spark):
    frame = spark.createDataFrame(
        [(1, 0.0, 0.0, 1.0, 0.0)],
        "frame_id long, blur_score double, mean_brightness double, dark_ratio double, "
        "bright_ratio double",
    )
    got = quality.quality_gate(frame).first()
    assert got.failures == ["severe_blur", "too_dark_or_black"] and not got.passed
    gone = quality.quality_gate(frame.withColumn("gone", F.lit(True)), missing="gone").first()
    assert gone.failures == ["missing_image"]


def test_ranking_and_best(spark):
    scored = spark.createDataFrame(
        [(1, 1, 1, 0, 0.5), (1, 1, 2, 1, 0.9), (1, 1, 3, 2, 0.9)],
        "video_id long, section_index long, frame_id long, timestamp_ms long, score double",
    )
    ranked = ranking.rank_frames(scored).orderBy("rank").collect()
    assert [r.frame_id for r in ranked] == [2, 3, 1]
    unscored = spark.createDataFrame(
        [(1, 1, 7, None, 2, 4), (1, 1, 8, None, 2, 3), (1, 1, 9, 1.0, 3, 1)],
        "video_id long, section_index long, frame_id long, score double, source_priority int, "
        "position long",
    )
    assert ranking.best_frame_per_section(unscored).first().frame_id == 8


def test_top_five_keeps_best_repeat(spark):
    frames = [(1, 1, i, None, None, s, p) for p, (i, s) in enumerate(
        [(1, 0.1), (2, 0.8), (3, 0.7), (4, 0.6), (5, 0.5), (6, 0.4), (7, 0.3), (8, 0.2), (1, 0.9)]
    )]
    df = spark.createDataFrame(
        frames,
        "video_id long, section_index long, frame_id long, object_key string, url string, "
        "score double, position long",
    )
    got = ranking.top_matches(df).orderBy("rank").collect()
    assert [(r.identity, r.rank) for r in got] == [
        ("1", 1), ("2", 2), ("3", 3), ("4", 4), ("5", 5),
    ]


def test_sentences_win_over_segments(spark):
    body = (
        '{"segments":[{"text":"all","start":0,"end":3}],"sentences":'
        '[{"text":" one ","start":0,"end":1.2},{"text":""},{"sentence":"two","timestamp":[1.2,2.4]}]}'
    )
    df = spark.createDataFrame([("v", body, 0)], "video_id string, response string, duration_ms long")
    good, bad = transcript.extract_sentences(df)
    assert [tuple(r)[1:] for r in good.orderBy("sentence_index").collect()] == [
        (0, 0.0, 1.2, "one"), (1, 1.2, 2.4, "two"),
    ]
    assert bad.count() == 0


def test_section_range_comes_from_sentences(spark):
    sentences = spark.createDataFrame(
        [("v", 0, 0.0, 1.0, "a  b"), ("v", 1, 1.0, 2.5, "c"), ("v", 2, 2.5, 4.0, "d")],
        "video_id string, sentence_index long, start_seconds double, end_seconds double, text string",
    )
    sections = spark.createDataFrame(
        [("v", 1, [2, 0, 1])], "video_id string, section_index long, source_indices array<long>"
    )
    assert tuple(transcript.section_ranges(sections, sentences).first())[2:] == (0.0, 4.0)
    assert transcript.section_texts(sections, sentences).first().text == "a b c d"
    parts = transcript.section_texts(sections, sentences, part_rows=2).orderBy("part_no").collect()
    assert [p.text for p in parts] == ["a b c", " d"]


@pytest.mark.parametrize(
    "content, want",
    [('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('x {"a":1} y', '{"a":1}'),
     ("[1]", "not_an_object"), ("{bad", "not_json"), ("{bad}", "malformed_json")],
)
def test_model_json(spark, content, want):
    df = spark.createDataFrame([(content,)], "content string")
    good, bad = responses.model_json(df, "content")
    found = good.select("json").collect() + bad.select("reason").collect()
    assert [r[0] for r in found] == [want]


def scene(spark, boxes, blur=100.0):
    detections = spark.createDataFrame(
        [(1, i + 1, label, conf, *map(float, box), 100, 100)
         for i, (label, conf, box) in enumerate(boxes)],
        "frame_id long, det_no int, label string, confidence double, x1 double, y1 double, "
        "x2 double, y2 double, width int, height int",
    )
    rows = scenes.normalize_detections(detections)
    frames = spark.createDataFrame([(1, blur)], "frame_id long, blur_score double")
    found = scenes.scene_relations(rows)
    return rows, found, scenes.frame_scenes(frames, rows, found)


def score(spark, boxes, edge=True, blur=100.0, frame_type="overview_frame"):
    rows, _, signs = scene(spark, boxes, blur)
    nodes = [("servo", "servo", "part", True, 0.5), ("base", "base", "part", True, 0.5)]
    edges = [("servo", "near", "base", False, 1.0)] if edge else []
    graphs = spark.createDataFrame(
        [("g", nodes, edges)],
        "graph_id string, nodes array<struct<id:string,label:string,role:string,"
        "required:boolean,weight:double>>, edges array<struct<`from`:string,relation:string,"
        "`to`:string,required:boolean,weight:double>>",
    )
    pairs = spark.createDataFrame(
        [(1, 1, 1, "g", frame_type, 0.8)],
        "video_id long, section_index long, frame_id long, graph_id string, frame_type string, "
        "quality_score double",
    )
    return scoring.match_score(pairs, graphs, rows, signs).first()


NEAR = [("servo", 0.9, (30, 30, 55, 55)), ("底座", 0.9, (50, 40, 75, 65))]
FAR = [("servo", 0.9, (2, 2, 20, 20)), ("底座", 0.9, (80, 80, 98, 98))]


def test_close_beats_far_and_synonyms_match(spark):
    near, far = score(spark, NEAR), score(spark, FAR)
    assert near.score > 0.5 and near.missing == [] and near.score > far.score
    assert near.matched[:2] == ["servo", "robot_arm_base"]


def test_without_edges_edge_score_is_zero(spark):
    got = score(spark, NEAR, edge=False)
    assert got.edge_score == 0 and got.score <= 0.68


def test_hand_occludes(spark):
    hand = [*NEAR, ("hand", 0.9, (35, 35, 70, 60))]
    clear, hidden = score(spark, NEAR), score(spark, hand)
    assert hidden.score < clear.score
    assert "occluded" in hidden.negative_hits and hidden.negative_hits.count("occluded") == 1


def test_blur_and_missing(spark):
    got = score(spark, NEAR[:1], blur=3.0)
    assert got.negative_hits[0] == "blur" and got.missing == ["robot_arm_base"]


def test_only_sharp_counts_as_expected_signal(spark):
    assert score(spark, NEAR, frame_type="completion_frame").signal_score == 0.5
    assert score(spark, NEAR, frame_type="alignment_frame").signal_score == 0.0


def test_relations_salted_equal_plain(spark, rows):
    boxes = [(n, 0.5, (i * 3, i * 2, i * 3 + 30, i * 2 + 30)) for i, n in
             enumerate(["hand", "a", "b", "a", "hand", "c"] * 5)]
    detections, plain, _ = scene(spark, boxes)
    assert rows(scenes.scene_relations(detections, max_detections=3)) == rows(plain)
    assert 0 < plain.count() <= 20


def test_hot_frames_match_as_cold_ones(spark, rows):
    boxes = [(n, c / 10, (i, i, i + 30, i + 20)) for i, (n, c) in
             enumerate([("servo", 9), ("servo", 9), ("big servo", 9), ("base", 3)] * 4)]
    detections, _, _ = scene(spark, boxes)
    graphs = spark.createDataFrame(
        [("g", [("a", "servo", "part", True, 0.5), ("b", "base", "part", True, 0.5)], [])],
        "graph_id string, nodes array<struct<id:string,label:string,role:string,"
        "required:boolean,weight:double>>, edges array<struct<`from`:string,relation:string,"
        "`to`:string,required:boolean,weight:double>>",
    )
    pairs = spark.createDataFrame(
        [(1, 1, 1, "g", "other")],
        "video_id long, section_index long, frame_id long, graph_id string, frame_type string",
    )
    found = [
        rows(scoring.match_nodes(pairs, graphs, detections, max_detections=n), "node_no",
             "object.det_no", "node_score")
        for n in (1, 10**6)
    ]
    assert found[0] == found[1] and len(found[0]) == 2


def test_markdown(spark):
    sections = spark.createDataFrame(
        [("v", 1, "One", "00:00", "00:10", "raw", "edited", 5, "00:04", "", "/f/5.jpg", 0.87654),
         ("v", 2, "Two", "00:10", "00:20", "raw", "", None, None, None, None, None)],
        "video_id string, section_index long, title string, start_time string, end_time string, "
        "text string, polished_text string, frame_ref long, timestamp_time string, "
        "frame_caption string, url string, score double",
    )
    videos = spark.createDataFrame(
        [("v", 'T"x', "a.mp4", 61_000)],
        "video_id string, video_title string, filename string, duration_ms long",
    )
    whole = documents.render_markdown(sections, videos).first().document
    assert "[业务帧](/f/5.jpg)\n  - 相似度分数：0.8765" in whole
    assert 'video_title: "T\\"x"' in whole and 'duration: "01:01"' in whole
    assert whole.endswith("### 业务帧\n\n- 无\n")
    parts = documents.render_markdown(sections, videos, part_rows=1).orderBy("part_no").collect()
    assert "".join(p.document for p in parts) == whole
    embedded = documents.render_markdown(sections, videos, embed=True).first().document
    assert "![业务帧](/f/5.jpg)" in embedded


def test_name_clash_gets_position(spark, rows):
    entries = spark.createDataFrame(
        [("v", "a/x.jpg", 0), ("v", "b/x.jpg", 1), ("v", "a/x.jpg", 2), ("v", "c/x_001.jpg", 3)],
        "video_id string, object_key string, position int",
    )
    assert rows(documents.unique_names(entries), "object_key", "local_name") == [
        ("a/x.jpg", "x.jpg"), ("b/x.jpg", "x_001.jpg"), ("c/x_001.jpg", "x_001_003.jpg"),
    ]


def test_name_clashes_follow_each_other(spark, rows):
    keys = [("a/x.jpg", 0), ("b/x.jpg", 3), ("c/x_003.jpg", 5), ("d/x_003_005.jpg", 9), ("e/y.jpg", 10)]
    entries = spark.createDataFrame(
        [("v", k, p) for k, p in keys], "video_id string, object_key string, position int"
    )
    assert rows(documents.unique_names(entries), "object_key", "local_name") == [
        ("a/x.jpg", "x.jpg"), ("b/x.jpg", "x_003.jpg"), ("c/x_003.jpg", "x_003_005.jpg"),
        ("d/x_003_005.jpg", "x_003_005_009.jpg"), ("e/y.jpg", "y.jpg"),
    ]


def plain_names(keys):
    used = {}
    for position, key in enumerate(keys):
        if key in used:
            continue
        name = key.rsplit("/", 1)[-1]
        if name in used.values():
            stem, suffix = name.rsplit(".", 1)
            name = f"{stem}_{position:03d}.{suffix}"
        used[key] = name
    return used


def test_names_of_a_long_chain(spark, rows, monkeypatch):
    """A thousand keys of which each is named what the one before it moves to; half as many
    in a chain that nothing moves; rounds grow with the logarithm."""
    keys, stem = ["a/x.jpg", "b/x.jpg"], "x_001"
    while len(keys) < 1000:
        keys.append(f"k{len(keys)}/{stem}.jpg")
        stem = f"{stem}_{len(keys) - 1:03d}"
    stem = "y"
    for n in range(len(keys), 1500):
        keys.append(f"k{n}/{stem}.jpg")
        stem = f"{stem}_{n:03d}"
    keys += ["b/x.jpg", "z/q.jpg", "w/q.jpg"]
    rounds, plain = [], documents.cut_lineage
    monkeypatch.setattr(documents, "cut_lineage", lambda df: rounds.append(1) or plain(df))
    entries = spark.createDataFrame(
        [("v", k, p) for p, k in enumerate(keys)], "video_id string, object_key string, position int"
    )
    got = dict(rows(documents.unique_names(entries), "object_key", "local_name"))
    assert got == plain_names(keys)
    assert len(rounds) <= 2 + 11


def test_token_counts_by_json_kind(spark):
    odd = '{"usage":{"prompt_tokens":"3.7","input_tokens":9,"completion_tokens":true}}'
    big = '{"usage":{"prompt_tokens":9007199254740993,"completion_tokens":2.9,"total_tokens":" 7 "}}'
    none = '{"usage":{"prompt_tokens":null,"completion_tokens":[1]}}'
    df = spark.createDataFrame([(0, odd), (1, big), (2, none), (3, "{")], "i int, r string")
    got = df.select("i", *[c.alias(n) for n, c in usage.usage_tokens("r").items()]).orderBy("i").collect()
    assert [tuple(g)[1:] for g in got] == [(9, 1, 10), (9007199254740993, 2, 7), (0, 0, 0), (0, 0, 0)]


def catalogue_rows(spark):
    names = ["uploaded", "queued", "processing", "completed", "completed_with_warnings",
             "failed", "deleting"]
    data = [(i, f"T{i}", "100%_a\\b.mp4" if i == 9 else f"f{i}.mp4", names[i % 7], i // 3 * 1000)
            for i in range(65)]
    return spark.createDataFrame(
        data, "id long, title string, filename string, status string, created_at long"
    )


def test_pages_and_literal_search(spark):
    videos = catalogue_rows(spark)
    seen = []
    for page in range(1, 5):
        got, info = catalogue.catalogue_page(videos, page, 20)
        seen += [r.id for r in got.collect()]
        assert tuple(info.first()) == (65, 4, page)
        deep, _ = catalogue.catalogue_page(videos, page, 20, shallow_rows=0, day_ms=5_000)
        assert [r.id for r in deep.collect()] == seen[(page - 1) * 20 :]
    assert seen == list(range(64, -1, -1))
    for needle in ("%", "_a", "\\"):
        assert [r.id for r in catalogue.catalogue_filter(videos, needle).collect()] == [9]
    empty = catalogue.catalogue_page(videos, 7, 20, "nothing")[1].first()
    assert (empty.total, empty.total_pages, empty.page) == (0, 1, 1)


def test_latest_state(spark, rows):
    updates = spark.createDataFrame(
        [("a", "completed", 2, 1), ("a", "processing", 1, 2), ("b", "completed", 2, 1),
         ("b", "processing", 3, 2), ("c", "failed", 2, 1), ("c", "processing", 2, 2),
         ("d", "completed", 1, 1), ("e", "completed", None, 1)],
        "id string, status string, updated_at long, seq long",
    )
    gone = spark.createDataFrame([("d",)], "id string")
    state, odd = catalogue.latest_state(updates, gone)
    assert rows(state, "id", "status") == [("a", "completed"), ("b", "processing"), ("c", "failed")]
    assert rows(odd, "id") == [("e",)]


def png(path, pixels):
    """8-bit RGB PNG from rows of (r, g, b)."""
    height, width = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(c for p in row for c in p) for row in pixels)

    def chunk(name, data):
        body = name + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw))
        + chunk(b"IEND", b"")
    )


def test_images_from_files(spark, tmp_path):
    first, second = tmp_path / "main", tmp_path / "spare"
    first.mkdir(), second.mkdir()
    black = [[(0, 0, 0)] * 40 for _ in range(32)]
    checker = [[((x // 4 + y // 4) % 2 * 255,) * 3 for x in range(40)] for y in range(32)]
    red = [[(255, 0, 0)] * 40 for _ in range(32)]
    png(first / "a.png", black)
    png(second / "a.png", checker)
    png(second / "b.png", checker)
    png(second / "c.png", red)
    found = images.read_frame_images(spark, [str(first), str(second)])
    got = {r.object_key: r for r in images.image_features(found).collect()}
    assert set(got) == {"a.png", "b.png", "c.png"}
    assert got["a.png"].dark_ratio == 1.0 and got["a.png"].blur_score == 0.0
    assert (got["a.png"].image_width, got["a.png"].image_height) == (40, 32)
    assert got["b.png"].mean_brightness == 127.5 and got["b.png"].blur_score > 1000
    assert got["c.png"].mean_brightness == 76.0
    assert got["c.png"].histogram[3 * 4 + 3] == 1.0  # hue 0, full saturation, full value
    gate = quality.quality_gate(images.image_features(found)).where("passed")
    assert [r.object_key for r in gate.collect()] == ["b.png"]


def test_replace_frames_touches_given_videos_only(spark, rows, tmp_path):
    path = str(tmp_path / "frames")
    schema = "video_id string, frame_id long"
    artifacts.replace_frames(
        spark, spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema), path, buckets=2
    )
    artifacts.replace_frames(spark, spark.createDataFrame([("a", 9)], schema), path, buckets=2)
    assert rows(spark.read.parquet(path), "video_id", "frame_id") == [("a", 9), ("b", 3)]
    gone = spark.createDataFrame([("a",), ("c",)], "video_id string")
    artifacts.replace_frames(spark, spark.createDataFrame([("d", 4)], schema), path, buckets=2, videos=gone)
    assert rows(spark.read.parquet(path), "video_id", "frame_id") == [("b", 3), ("d", 4)]


def test_artifacts_round_trip(spark, rows, tmp_path):
    from pyspark.sql import types as T

    for video, body in (("v1", '{"title":"x"}'), ("v2", "{oops"), ("v3", " \n"), ("v4", "")):
        folder = tmp_path / "videos" / video / "transcript"
        folder.mkdir(parents=True)
        (folder / "transcript_tree.json").write_text(body)
    schema = T.StructType([T.StructField("title", T.StringType())])
    good, bad = artifacts.read_artifacts(spark, f"{tmp_path}/videos/*/transcript/*.json", schema)
    assert rows(good) == [("v1", "x")]
    assert rows(bad) == [("v2", "corrupt"), ("v3", "empty"), ("v4", "empty")]
    artifacts.write_artifacts(good, str(tmp_path / "out"), "tree")
    assert rows(spark.read.json(str(tmp_path / "out" / "kind=tree")), "video_id") == [("v1",)]


def test_label_export(spark, rows, tmp_path):
    (tmp_path / "images").mkdir(), (tmp_path / "labels").mkdir()
    (tmp_path / "classes.txt").write_text("servo\n\n base \n")
    (tmp_path / "images" / "one.JPG").write_bytes(b"1")
    (tmp_path / "labels" / "one.txt").write_text("0 0.5 0.5 0.1 0.1\n1 0.2 0.2 0.1 0.1\n")
    classes, image_rows, files, lines = artifacts.read_label_export(spark, str(tmp_path))
    assert rows(classes, "text") == [(" base ",), ("",), ("",), ("servo",)]
    assert rows(image_rows, "stem", "suffix") == [("one", ".jpg")]
    assert rows(files) == [("one",)]
    assert rows(lines, "stem", "line_no") == [("one", 0), ("one", 1)]


def test_image_size_from_the_largest_corner(spark, rows):
    data = [
        (1, 1, 10.0, 10.0, 90.2, 40.0, 0, 0), (1, 2, 0.0, 0.0, 20.0, 120.5, None, 0),
        (2, 1, 0.0, 0.0, 700.0, 30.0, 640, 0), (3, 1, 0.0, 0.0, 700.0, 30.0, 640, 360), (4, 1, -5.0, -5.0, -1.0, -1.0, 0, 0),
    ]
    raw = spark.createDataFrame(
        [(f, n, "cup", 0.5, *rest) for f, n, *rest in data], "frame_id long, det_no long, label string, "
        "confidence double, x1 double, y1 double, x2 double, y2 double, width int, height int",
    )
    sized = scenes.fill_image_size(scenes.normalize_detections(raw, None))
    assert rows(sized.select("frame_id", "width", "height").distinct()) == [
        (1, 91, 121), (2, 700, 30), (3, 640, 360), (4, 1, 1),
    ]
