"""What larger tables showed: joins, plans and results that small tables do not tell apart."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from reelgraph.functions.rows import keep_where
from reelgraph.operators import dataset, dedup, intervals, querygraph, ranking, scenes, scoring, transcript
from reelgraph.plans import bindings
from reelgraph.plans.queries import QUERIES
from reelgraph.session import spread
from reelgraph.sources import images
from reelgraph.streaming import jobs


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_windows_are_never_broadcast(spark):
    frames = spark.range(50).select(F.lit(1).alias("video_id"), F.col("id").alias("frame_id"), (F.col("id") * 100).alias("timestamp_ms"))
    sections = spark.createDataFrame([(1, 1, 500, 2_000), (1, 2, 0, 9_000)], "video_id int, section_index int, start_ms bigint, end_ms bigint")
    for found in (
        intervals.frames_in_sections(frames, sections, 0, bucket_ms=1_000),
        intervals.relevant_frames(frames, sections, 0, bucket_ms=1_000),
    ):
        assert "Broadcast" not in physical(found)
    assert intervals.frames_in_sections(frames, sections, 0, bucket_ms=1_000).count() == 16 + 50


def test_find_frame_meets_its_target_once(spark, rows):
    kind = "video_id int, section_index int, frame_id int, object_key string, url string"
    listed = spark.createDataFrame(
        [(1, 1, 7, None, None, 3), (1, 1, None, "k", None, 2), (1, 1, 8, "x", "u", 1), (1, 2, 7, "k", "u", 1)],
        kind + ", position int",
    )
    targets = spark.createDataFrame([(1, 1, 7, "k", None), (1, 2, 9, None, "v")], kind)
    found = ranking.find_frame(listed, targets)
    assert rows(found, "section_index", "position") == [(1, 2)]
    assert plan_of(found).count("Join ") == 1


def test_a_descriptor_is_one_text_however_many_names(spark):
    classes = spark.range(2_500).select(
        F.lit(3).alias("dataset"), F.col("id").alias("class_id"), F.concat(F.lit("n"), "id").alias("name")
    )
    found = dataset.data_yaml(classes, "/data").collect()
    assert [(r.dataset, r.part_no) for r in found] == [(3, 0)]
    lines = found[0].data_yaml.split("\n")
    assert lines[3:6] == ["nc: 2500", "names:", "  0: n0"]
    assert lines[-2:] == ["  2499: n2499", ""] and len(lines) == 5 + 2_500 + 1


def test_graphs_are_read_once_whatever_is_asked_of_them(spark):
    text = '{"nodes":[{"id":"A","label":"x","role":"r","required":true,"weight":1}],"edges":[]}'
    answers = spark.createDataFrame([(1, 1, text), (2, 1, "[1]")], "graph_id int, attempt int, graph string")
    checked = querygraph.validate_query_graphs(answers, "graph")
    bad = keep_where(checked, F.col("reason").isNotNull()).select("graph_id", "reason")
    for asked in (querygraph.graph_nodes(checked, "graph_id"), querygraph.graph_edges(checked, "graph_id"), bad):
        assert plan_of(asked).count("parseJson") == 1
    assert [tuple(r) for r in bad.collect()] == [(2, "query_graph_missing")]
    assert [(r.graph_id, r.node_no, r.id) for r in querygraph.graph_nodes(checked, "graph_id").collect()] == [(1, 0, "a")]
    assert querygraph.graph_edges(checked, "graph_id").isEmpty()


def test_graph_answers_of_one_small_file_are_dealt_over_tasks(spark, tmp_path):
    spark.range(10).selectExpr(
        "id p_partkey", "'n' p_name", "'t' p_type", "'b' p_brand", "1 p_size"
    ).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert bindings.graph_answers(spark, str(tmp_path)).rdd.getNumPartitions() == 4


def test_retries_are_told_above_the_exchange(spark):
    bad = spark.createDataFrame([(1, 1, "query_graph_x"), (2, 1, "other"), (3, 9, "query_graph_x")], "graph_id int, attempt int, reason string")
    read = spread(bad).withColumn("reason", F.regexp_replace("reason", "x", "y"))
    again = transcript.retry_set(read)
    assert [(r.graph_id, r.attempt) for r in again.collect()] == [(1, 2)]
    assert plan_of(again).split("Repartition")[1].count("regexp_replace") == 0


def test_measures_leave_python_in_small_batches(spark):
    import pandas as pd

    one = {"height": 2, "width": 2, "nChannels": 1, "data": bytes(4)}
    batch = pd.DataFrame([one] * (images.MEASURED_ROWS + 1))
    assert [len(x) for x in images._features.func(iter([batch]))] == [images.MEASURED_ROWS, 1]


def test_labels_are_normalised_once_under_a_filter(spark):
    raw = spark.createDataFrame(
        [(1, 1, "Robot-arm base", 0.5), (1, 2, "--", 0.5)], "frame_id int, det_no int, label string, confidence double"
    ).selectExpr("*", "1D x1", "1D y1", "2D x2", "2D y2", "10 width", "10 height")
    found = scenes.normalize_detections(raw).where("label != ''")
    assert [r.label for r in found.collect()] == ["robot_arm_base"]
    assert plan_of(found).count("regexp_replace") == 1


def test_the_whole_parse_scores_its_pairs_once(spark):
    ranked = QUERIES["parse_videos"](spark, "/root/testdata/sf0.001")
    assert "regexp_replace" not in plan_of(ranked) and "Relation [" not in plan_of(ranked)
    assert ranked.count() > 0


def test_frames_lead_to_no_chunk_after_the_window_of_their_section(spark, monkeypatch):
    frames = spark.range(60).selectExpr(
        "1 video_id", "1 section_index", "id frame_id", "id * 10 timestamp_ms", "0.5D quality_score",
        "id % 7 phash", "array(1.0F, float(id % 3)) histogram", "bigint(590) window_end_ms",
    )
    limits = bindings.config.DedupLimits(window_ms=100)
    arranged, dealt = dedup.arranged, []
    monkeypatch.setattr(dedup, "arranged", lambda rows, *a: dealt.append(rows) or arranged(rows, *a))
    plain = dedup.near_duplicate_groups(frames.drop("window_end_ms"), limits, chunk_ms=300).collect()
    without = dealt[0].where("_warm").groupBy("_chunk").count().collect()
    dealt.clear()
    told = dedup.near_duplicate_groups(frames, limits, chunk_ms=300).collect()
    assert {r["_chunk"] for r in without} == {1, 2}
    assert {r["_chunk"] for r in dealt[0].where("_warm").collect()} == {1}
    assert sorted(told) == sorted(plain) and len(told) == 60


def test_detections_cross_the_network_once(spark, tmp_path):
    """By frame, and only there: all that meet a frame read the same exchange."""
    items = [(k % 30, 1 + k % 3, k % 5, k % 7, 3.0 + k % 2, 0.01 * (k % 4), 10.0 * k) for k in range(120)]
    spark.createDataFrame(
        items, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
        "l_discount double, l_extendedprice double"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5).selectExpr(
        "id p_partkey", "concat('part ', id) p_name", "concat('Brand#', id + 1) p_brand"
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(30).selectExpr("id o_orderkey", "id o_custkey", "id * 7.0D o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["match_score"](spark, str(tmp_path))
    assert {r.frame_id for r in found.collect()} <= {k for k in range(30) if k % 20}
    ran = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = {line.split("plan_id=")[1] for line in ran.split("\n") if " Exchange hashpartitioning(frame_id" in line}
    assert len(dealt) == 3  # Frames, the query nodes of their pairs, and detections.
    assert "Exchange hashpartitioning(l_orderkey" not in ran


def test_label_words_are_counted_for_labels_that_share_one(spark):
    labels = ["a", "a b", "b c d", "c a d e", "x", "x a y b z", "", "a a a q"]
    pairs = spark.createDataFrame([(q, f) for q in labels for f in labels], "q string, f string")
    found = pairs.withColumn("fits", scoring.labels_compatible(F.col("q"), F.col("f")))
    for q, f, fits in found.collect():
        own, other = set(q.split(" ")), set(f.split(" "))
        shared, smaller = len(own & other), min(len(own), len(other))
        assert fits == (q == f or q in f or f in q or shared > 0 and (smaller <= 2 or shared / smaller >= 0.5))
    assert plan_of(found).count("array_intersect") == 1


def test_only_undecided_uploads_reach_the_state():
    class Flag:
        held = False

        def exists(self):
            return self.held

        def update(self, value):
            self.held = True

    judge = jobs._Taken(["id", "seq"])
    judge.taken = Flag()
    arrived = [Row(id=5, seq=2, reason=None), Row(id=5, seq=1, reason=None)]
    found = [(r.seq, r.reason) for r in judge.handleInputRows((5,), iter(arrived), None)]
    assert sorted(found) == [(1, None), (2, "duplicate_id")]
