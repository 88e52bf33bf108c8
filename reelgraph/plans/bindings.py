"""Driver tables read as operator inputs.

Each function maps the given parquet tables to the columns an operator expects,
row by row where possible, so that the binding itself adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.functions import text, vectors
from reelgraph.functions.rows import keep_where
from reelgraph.operators import scenes
from reelgraph.session import configure, spread

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
ORIGIN_MS = 1_704_067_200_000  # 2024-01-01T00:00:00Z, the start of ``events``
SECTION_MS = 5 * DAY_MS
PAD_MS = 6 * HOUR_MS
BUCKET_MS = DAY_MS
CHUNK_MS = 10 * DAY_MS  # a third of the span of ``events``: folds cross chunk borders
HAND_LABEL = "red plate"
SYNONYMS = {**config.LABEL_SYNONYMS, HAND_LABEL: "hand"}
IMAGE_WIDTH, IMAGE_HEIGHT = 960, 540

DEDUP = config.DedupLimits(window_ms=DAY_MS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    ms = millis("ts") - F.lit(ORIGIN_MS)
    return events.select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("frame_id"),
        ms.alias("timestamp_ms"),
        F.col("event_type"),
        F.col("value").alias("blur_score"),
        (k * 2.55).alias("mean_brightness"),
        ((F.col("event_id") % 97) / 97.0).alias("dark_ratio"),
        ((F.col("event_id") % 89) / 89.0).alias("bright_ratio"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-day blocks of a video's purchases: first to last purchase."""
    index = (F.floor(F.col("timestamp_ms") / SECTION_MS) + 1).alias("section_index")
    return (
        frames(spark, sf_dir)
        .where(F.col("event_type") == "purchase")
        .groupBy("video_id", index)
        .agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"))
    )


def features(spark: SparkSession, sf_dir: str, rows: DataFrame, *names: str) -> DataFrame:
    """Attach a vector per frame: it stands for the histogram and the hash block.

    names: which of ``histogram`` and ``phash`` (both). The vector stays as it is stored, in
    4-byte numbers.
    """
    embeddings = table(spark, sf_dir, "embeddings")
    count = embeddings.agg(F.count(F.lit(1))).scalar()
    vec_id = (F.col("video_id") * 7 + F.col("frame_id") % 5) % count
    vecs = embeddings.select(
        "vec_id", F.col("embedding").alias("histogram"), vectors.pack64(F.col("embedding")).alias("phash")
    ).select("vec_id", *(names or ("histogram", "phash")))
    return rows.withColumn("vec_id", vec_id).join(vecs, "vec_id").drop("vec_id")


def videos_with_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("video_id"),
        F.floor(F.col("c_acctbal") * 10).alias("duration_ms"),
    )


def scene_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("video_id"),
        ((F.col("o_orderkey") * 37) % 110_000 - 500).alias("timestamp_ms"),
    )


def long_scene_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as times on an 8-minute axis; durations follow the key."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("video_id"),
        F.floor("o_totalprice").alias("timestamp_ms"),
        (F.col("o_custkey") % 4 * 120_000).alias("duration_ms"),
    )


def scene_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_id"),
        (F.col("l_extendedprice") / 100).alias("pts_seconds"),
        (F.col("l_discount") * 4).alias("scene_score"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("clip_"), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias(
            "filename"
        ),
        F.element_at(
            F.create_map(
                F.lit("O"), F.lit("processing"), F.lit("F"), F.lit("failed"),
                F.lit("P"), F.lit("completed"),
            ),
            F.col("o_orderstatus"),
        ).alias("status"),
        millis("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("size_bytes"),
        F.col("o_custkey").alias("owner"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_job_events(table(spark, sf_dir, "events"))


def as_job_events(events: DataFrame) -> DataFrame:
    """Events as job-status updates; some carry no time."""
    return events.select(
        F.col("user_id").alias("id"),
        F.col("event_type").alias("status"),
        F.when(F.col("event_id") % 50 > 0, F.floor(millis("ts") / DAY_MS)).alias("updated_at"),
        F.col("event_id").alias("seq"),
    )


EVENT_TERMINAL = ("purchase", "error")


def field_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as partial job updates: each type sets other fields."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("seq"),
        F.when(kind != "view", kind).alias("status"),
        F.when(kind.isin("view", "click"), F.floor(value * 3 - 20)).alias("progress_percent"),
        F.when(kind == "click", F.floor(value) - 30).alias("stage_processed"),
        F.when(kind == "signup", F.repeat(F.concat(kind, F.lit(" ")), 60)).alias("stage_message"),
        millis("ts").alias("updated_at"),
    )


def customer_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.lower("c_mktsegment").alias("status"),
        F.lit(10).cast("bigint").alias("progress_percent"),
        F.lit(0).cast("bigint").alias("stage_processed"),
        F.lit("waiting").alias("stage_message"),
        F.lit(ORIGIN_MS).cast("bigint").alias("updated_at"),
    )


STATUS_BY_CODE = {"O": "processing", "F": "failed", "P": "completed"}


def stored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as frame rows of the order catalogue, with object keys."""
    key = F.concat(
        F.lit("videos/"), F.col("l_orderkey").cast("string"), F.lit("/frames/"),
        F.lpad(F.floor("l_extendedprice").cast("string"), 9, "0"), F.lit(".jpg"),
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_id"),
        F.col("l_partkey").alias("frame_id"),
        F.floor("l_extendedprice").alias("timestamp_ms"),
        key.alias("object_key"),
        F.element_at(
            F.create_map(F.lit("A"), F.lit("selected"), F.lit("R"), F.lit("rejected")),
            F.col("l_returnflag"),
        ).alias("selection_status"),
        F.col("l_discount").alias("selection_score"),
        F.col("l_linenumber").cast("bigint").alias("matched_section_index"),
        F.concat(F.lit("bucket-"), F.col("l_linestatus")).alias("bucket"),
    )


def usage_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger calls: a sign-up starts a parse, a purchase is a model
    call of the parse its ``props`` name; the response carries token counts
    under changing names."""
    kind, event_id = F.col("event_type"), F.col("event_id")
    parent = kind == "signup"
    mode = F.element_at(
        F.array(*[F.lit(m) for m in ("transcript", "keyframes", "markdown", "full")]),
        (event_id % 4 + 1).cast("int"),
    )
    tokens = F.floor(F.col("value")).cast("string")
    number = (event_id % 5).cast("int")
    names = ("prompt_tokens", "input_tokens", "promptTokens", "inputTokens", "none")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), number + 1)
    usage = F.concat(
        F.lit('{"model":"'), F.when(event_id % 3 == 0, F.lit("m1")).otherwise(F.lit("")),
        F.lit('","usage":{"'), name, F.lit('":"'), tokens,
        F.lit('","completion_tokens":'), number.cast("string"), F.lit("}}"),
    )
    # A quoted decimal is no count, the next key is; a boolean counts as 0 or 1.
    odd = F.concat(
        F.lit('{"model":"'), F.when(event_id % 3 == 0, F.lit("m1")).otherwise(F.lit("")),
        F.lit('","usage":{"prompt_tokens":"'), tokens, F.lit('.5","input_tokens":'),
        (event_id % 11).cast("string"), F.lit(',"completion_tokens":true}}'),
    )
    usage = F.when(event_id % 7 == 0, odd).otherwise(usage)
    return (
        table(spark, sf_dir, "events")
        .where(kind.isin("signup", "purchase"))
        .select(
            event_id.cast("string").alias("id"),
            F.col("user_id").alias("video_id"),
            F.when(parent, F.lit("background")).otherwise(F.lit("model")).alias("interface_type"),
            F.when(parent, F.lit(config.PARSE_ENDPOINT))
            .otherwise(F.lit(config.TRANSCRIPT_MODEL_CALLS[1]))
            .alias("tool_or_endpoint"),
            F.when(parent, mode).alias("mode"),
            F.lit("").alias("request_model"),
            F.when(parent & (event_id % 2 == 0), F.lit("{}")).otherwise(usage).alias("response"),
            F.when(~parent, F.col("user_id").cast("string")).alias("_asked_by"),
            F.when(F.col("value") > 60, F.lit("failed")).otherwise(F.lit("completed")).alias(
                "status"
            ),
            millis("ts").alias("created_at"),
        )
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), F.split("text", "\n").alias("lines")
    )


def speech_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as speech answers: one sentence per line, in six field styles."""
    style = F.col("video_id") % 6

    def styled(build) -> Column:
        return F.to_json(F.struct(F.transform("lines", build).alias("sentences")))

    def clock(i: Column) -> Column:
        return F.concat(
            F.floor(i / 24).cast("string"), F.lit(":"), ((i % 24) * 2.5).cast("string")
        )

    def number(i: Column, shift: float = 0.0) -> Column:
        return i * 2.5 + shift

    answer = (
        F.when(style == 0, styled(lambda t, i: F.struct(
            t.alias("text"), number(i).alias("start"), number(i, 2.5).alias("end"))))
        .when(style == 1, styled(lambda t, i: F.struct(
            t.alias("transcript"), clock(i).alias("start_seconds"),
            clock(i + 1).alias("end_seconds"))))
        .when(style == 2, styled(lambda t, i: F.struct(
            t.alias("sentence"),
            F.array(i * 2500 + 200_000, i * 2500 + 202_500).alias("timestamp"))))
        .when(style == 3, styled(lambda t, i: F.struct(
            t.alias("text"), number(i).alias("begin"),
            F.when(i % 5 < 4, number(i, 1.0)).alias("finish"))))
        .when(style == 4, styled(lambda t, i: F.struct(
            t.alias("text"), number(i).cast("string").alias("start"),
            number(i, 1.5).cast("string").alias("end"))))
        .otherwise(F.to_json(F.struct(F.col("lines").alias("segments"))))
    )
    duration = F.when(F.col("video_id") % 12 == 6, F.lit(10_000)).otherwise(F.lit(0))
    return document_lines(spark, sf_dir).select(
        "video_id", answer.alias("response"), duration.alias("duration_ms")
    )


def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped as model answers: plain, fenced, embedded, cut, no object."""
    body = F.to_json(F.struct(F.col("lang").alias("title"), F.col("text").alias("text")))
    style = F.col("doc_id") % 5
    content = (
        F.when(style == 0, body)
        .when(style == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(style == 2, F.concat(F.lit("Here it is: "), body, F.lit(" done.")))
        .when(style == 3, F.concat(F.lit("{"), body))
        .otherwise(F.to_json(F.array("lang", "source")))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), F.length("text").alias("chars"),
        content.alias("content"),
    )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn") * 10.0
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("sentence_index"),
        start.alias("start_seconds"),
        (start + F.length("text") / 15.0).alias("end_seconds"),
        "text",
    )


def raw_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three turns per section; faults follow the conversation number."""
    block = F.floor(F.col("turn") / 3)
    style = F.col("video_id") % 7
    grouped = (
        table(spark, sf_dir, "conversations")
        .groupBy(F.col("conv_id").alias("video_id"), (block + 1).alias("section_index"))
        .agg(
            F.min("turn").alias("_lo"), F.max("turn").alias("_hi"),
            F.min_by("role", "turn").alias("title"),
        )
    )
    whole = F.sequence("_lo", "_hi")
    indices = (
        F.when(style == 1, F.filter(whole, lambda x: x != F.col("_lo") + 1))
        .when((style == 2) & (F.col("_lo") > 0), F.sequence(F.col("_lo") - 1, F.col("_hi")))
        .when((style == 3) & (F.col("_hi") > F.col("_lo")),
              F.sequence(F.col("_lo"), F.col("_hi") - 1))
        .when(style == 6, F.slice(whole, 1, 0))
        .otherwise(whole)
    )
    return grouped.select(
        "video_id", "section_index", "title", indices.alias("source_indices"),
        F.when(style == 4, F.lit("  ")).otherwise(F.lit("clear words")).alias("polished_text"),
        F.when(style == 5, F.lit("")).otherwise(F.lit("a still picture")).alias(
            "business_frame_text"
        ),
    )


def graph_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as query-graph answers; the key decides which rule is broken."""
    k = F.col("p_partkey") % 14

    def pick(cases: dict[int, str], default: str) -> Column:
        chain = F
        for case, value in cases.items():
            chain = chain.when(k == case, F.lit(value))
        return chain.otherwise(F.lit(default))

    first = F.concat(
        F.lit('{"id":"A","label":"'), F.col("p_name"), F.lit('","role":"'),
        F.when(k == 1, F.lit("")).otherwise(F.col("p_type")),
        F.lit('","required":'), pick({2: "1"}, "true"),
        F.lit(',"weight":'), pick({3: '"0.5"', 4: "-1"}, "0.5"), F.lit("}"),
    )
    second = F.concat(
        F.lit('{"id":"'), pick({5: "a"}, "B part"), F.lit('","label":"'), F.col("p_brand"),
        F.lit('","role":"part","required":false,"weight":'), F.col("p_size").cast("string"),
        F.lit("}"),
    )
    edge = F.concat(
        F.lit('{"from":"a","relation":"'), pick({6: ""}, "Next To"), F.lit('","'),
        pick({7: "target"}, "to"), F.lit('":"'), pick({8: "c"}, "b_part"),
        F.lit('","required":'), pick({9: "null"}, "false"), F.lit(',"weight":1}'),
    )
    graph = (
        F.when(k == 10, F.lit("[1]"))
        .when(k == 11, F.lit('{"nodes":[],"edges":[]}'))
        .when(k == 12, F.concat(F.lit('{"nodes":['), first, F.lit("]}")))
        .when(k == 13, F.concat(F.lit('{"nodes":['), first, F.lit(',7],"edges":[]}')))
        .otherwise(F.concat(
            F.lit('{"nodes":['), first, F.lit(","), second, F.lit('],"edges":['), edge,
            F.lit("]}"),
        ))
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    return spread(parts).select(
        F.col("p_partkey").alias("graph_id"), (F.col("p_size") % 2 + 1).alias("attempt"),
        graph.alias("graph"),
    )


def titled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as titled sections; line item terms come from the whole text."""
    words = F.array(*[F.lit(w) for w in ("接线完成", "安装工具", "测试结果", "孔位对齐", "展示组件", "其他")])
    title = F.element_at(words, (F.col("doc_id") % 6 + 1).cast("int"))
    node = F.struct(F.concat(F.col("lang"), F.lit("-Part")).alias("label"))
    other = F.struct(F.col("source").alias("label"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), title.alias("title"), F.lit("").alias("text"),
        F.col("text").alias("polished_text"),
        F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("画面 "), F.col("lang"))).alias(
            "business_frame_text"
        ),
        F.array(node, other, node).alias("nodes"),
    )


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as detections of the order's frame, numbered within it.

    They cross the network by frame once, as stored, and what meets a frame later finds them
    there. The order names every column that a detection is made of: each use then asks for
    the same columns, and all of them read one exchange.
    """
    order = Window.partitionBy("frame_id").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity", "label"
    )
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    items = table(spark, sf_dir, "lineitem").join(
        names, F.col("l_partkey") == F.col("p_partkey")
    )
    numbered = items.select(
        F.col("l_orderkey").alias("frame_id"), "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice", "l_discount", "l_quantity", F.col("p_name").alias("label"),
    ).withColumn("det_no", F.row_number().over(order))
    x1, y1 = (F.col("l_suppkey") % 50) * 12.0, (F.col("l_partkey") % 40) * 9.0
    return numbered.select(
        "frame_id", "det_no", "label",
        (F.lit(1.0) - F.col("l_discount") * 5).alias("confidence"),
        x1.alias("x1"), y1.alias("y1"),
        (x1 + F.col("l_quantity") * 6).alias("x2"), (y1 + F.col("l_quantity") * 5).alias("y2"),
        F.lit(IMAGE_WIDTH).alias("width"), F.lit(IMAGE_HEIGHT).alias("height"),
    )


def detection_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_id"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.normalize_detections(raw_detections(spark, sf_dir), SYNONYMS)


def masked_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw detections with a 32 x 18 mask on two of three."""
    has_mask = F.col("det_no") % 3 > 0
    return raw_detections(spark, sf_dir).select(
        "*", has_mask.alias("has_mask"), F.lit(32).alias("mask_width"),
        F.lit(18).alias("mask_height"),
    )


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set pixels: a short diagonal per masked detection, none on narrow boxes."""
    length = F.floor((F.col("x2") - F.col("x1")) / 60).cast("int")
    steps = F.explode(F.sequence(F.lit(0), length - 1))
    masked = masked_detections(spark, sf_dir).where(F.col("has_mask") & (length > 0))
    return masked.withColumn("i", steps).select(
        "frame_id", "det_no",
        (F.floor(F.col("x1") / 30) + F.col("i")).alias("x"),
        (F.floor(F.col("y1") / 30) + F.col("i") % 3).alias("y"),
    )


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as detector-analysed frames; every twentieth has no result.

    A plain filter would go over to some of the detections that these frames meet, and
    those would cross the network a second time beside the others.
    """
    return keep_where(table(spark, sf_dir, "orders"), F.col("o_orderkey") % 20 > 0).select(
        F.col("o_orderkey").alias("frame_id"),
        (F.floor("o_totalprice") % 100).cast("double").alias("blur_score"),
    )


FRAME_TYPES = (
    "wiring_frame", "operation_frame", "completion_frame", "alignment_frame", "overview_frame",
    "other",
)


def scoring_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as (section, frame) pairs; the customer names the query graph."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    kinds = F.array(*[F.lit(t) for t in FRAME_TYPES])
    return table(spark, sf_dir, "orders").select(
        (cust % 150).alias("video_id"),
        (cust % 5).alias("section_index"),
        key.alias("frame_id"),
        F.concat(F.lit("Brand#"), (cust % 25 + 1).cast("string")).alias("graph_id"),
        F.element_at(kinds, (key % 6 + 1).cast("int")).alias("frame_type"),
        (F.floor("o_totalprice") % 101 / 100.0).alias("quality_score"),
    )


def brand_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand a graph of its two smallest part names and one relation."""
    first = Window.partitionBy("p_brand").orderBy("p_name")
    names = (
        table(spark, sf_dir, "part")
        .select("p_brand", "p_name")
        .distinct()
        .withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= 2)
    )
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    relation = F.element_at(
        F.array(*[F.lit(x) for x in ("near", "fixed_to", "behind")]), F.col("k") % 3 + 1
    )
    node = F.struct(
        F.concat(F.lit("n"), F.col("n").cast("string")).alias("id"),
        F.col("p_name").alias("label"),
        F.lit("part").alias("role"),
        (F.col("n") == 1).alias("required"),
        F.when(F.col("n") == 1, F.lit(0.6)).otherwise(F.lit(0.4)).alias("weight"),
    )
    edge = F.struct(
        F.lit("n1").alias("from"), relation.alias("relation"), F.lit("n2").alias("to"),
        (F.col("k") % 2 == 0).alias("required"), F.lit(0.0).alias("weight"),
    )
    grouped = names.groupBy("p_brand").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    return grouped.withColumn("k", number).select(
        F.col("p_brand").alias("graph_id"),
        "nodes",
        F.filter(F.array(edge), lambda e: F.size("nodes") > 1).alias("edges"),
    )


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as sections, three of four with a chosen frame."""
    v, s = F.col("conv_id"), F.col("turn") + 1
    shown = (v + s) % 4 > 0
    key = F.concat(
        F.lit("videos/"), v.cast("string"), F.lit("/frames/"),
        F.lpad((s % 3 * 1000).cast("string"), 9, "0"), F.lit("/a "), (s % 2).cast("string"),
        F.lit(".PNG"),
    )
    start = (s - 1) * 10.0
    return table(spark, sf_dir, "conversations").select(
        v.alias("video_id"),
        s.alias("section_index"),
        F.col("role").alias("title"),
        text.format_timestamp(start).alias("start_time"),
        text.format_timestamp(start + 9).alias("end_time"),
        F.col("text"),
        F.when(s % 2 == 0, F.concat(F.lit(" edited "), F.col("role"))).alias("polished_text"),
        F.when(s % 3 > 0, F.lit("画面")).otherwise(F.lit("")).alias("business_frame_text"),
        F.when(shown, v * 10 + s).alias("frame_ref"),
        F.when(shown, text.format_timestamp(start + 1)).alias("timestamp_time"),
        F.when(shown, F.lit("")).alias("frame_caption"),
        F.when(shown, key).alias("object_key"),
        F.when(shown & (s % 5 > 0), F.concat(F.lit("/f/"), s.cast("string"))).alias("url"),
        F.when(shown & (s % 6 > 0), ((v * 31 + s * 17) % 1000) / 1000.0).alias("score"),
    )


def document_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("turn") == 0)
        .select(
            F.col("conv_id").alias("video_id"),
            F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit('A "'), F.col("role"), F.lit('"')))
            .alias("video_title"),
            F.concat(F.lit("v"), F.col("conv_id").cast("string"), F.lit(".mp4")).alias("filename"),
            (F.col("conv_id") % 5 * 60_000).alias("duration_ms"),
        )
    )


def dataset_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("doc_id") % 13 == 0, F.lit(".gif")).otherwise(F.lit(".JPG"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("stem"), suffix.alias("suffix"), F.col("text").alias("content")
    )


def dataset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("stem"))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines per label file; the stem decides what is wrong with the second."""
    stem = F.col("doc_id")
    broken = F.element_at(
        F.array(*[F.lit(x) for x in (
            "1 0.5 0.5 0.1 0.1", "7 0.5 0.5 0.1 0.1", "1 0.5 0.5 0.1", "0 1.5 0.5 0.1 0.1",
            "x 0.5 0.5 0.1 -0.1", "1 0.5 0.5 0.1 a",
        )]),
        (stem % 6 + 1).cast("int"),
    )
    good = F.concat(F.col("quality").cast("string"), F.lit(" 0.25 0.25 0.5 "), F.lit("1"))
    return table(spark, sf_dir, "labels").select(
        stem.alias("stem"), F.posexplode(F.array(good, broken)).alias("line_no", "line")
    )


def pixel_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors drawn as 8 x 8 gray images: value v becomes (v + 0.5) * 255."""
    level = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.5) * 255))),
    )
    data = F.unhex(F.array_join(F.transform(level, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.struct(
            F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"),
            data.alias("data"),
        ).alias("image"),
    )


def media_arrivals(df: DataFrame) -> DataFrame:
    """Events as uploads of their user's video."""
    suffix = F.element_at(
        F.array(*[F.lit(x) for x in (".mp4", ".MKV", ".avi", "", ".webm")]),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    size = F.floor(F.col("value")) - 3
    return df.select(
        (F.col("user_id") * 3 + F.col("event_id") % 3).alias("id"),
        F.concat(F.lit("dir/clip"), suffix).alias("filename"),
        size.alias("size_bytes"),
        F.col("event_id").alias("seq"),
    )


MAX_BYTES = 100
