"""Graph matching of sections and frames.

One row per (section, frame) pair is scored by how well the frame's objects
fit the section's query graph. Everything is keyed by frame. A detector returns
a dozen boxes per frame; should a frame hold very many, they shrink ahead of the
match to the best object per (frame, label), as within a label the best choice
does not depend on the query.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.functions import geometry as g
from reelgraph.functions import text
from reelgraph.functions.geometry import Box
from reelgraph.functions.rows import bind
from reelgraph.operators.querygraph import expected_signals, graph_terms
from reelgraph.operators.scenes import MASK_BOX
from reelgraph.operators.skew import split_hot

PAIR = ("video_id", "section_index", "frame_id")
PAIR_TOLD = ("graph_id", "frame_type", "quality_score")
IDEALS = (0.04, 0.05, 0.06, 0.08, 0.10)
OPERATION_IDEAL = config.IDEAL_AREA["operation_frame"]


def _quality(ideal: Column) -> Column:
    center = g.image_center_distance(
        F.col("centroid_x"), F.col("centroid_y"), F.col("width"), F.col("height")
    )
    return g.object_quality(
        F.col("confidence"), F.col("area"), center, F.col("touches_border"), ideal
    )


def best_objects(detections: DataFrame) -> DataFrame:
    """Best object per (frame, label) for every ideal area a frame type may ask.

    ``best``: one struct per value of ``IDEALS``; ``label_place``: where the
    label first appears among the frame's detections.
    """
    qualities = {f"_q{i}": _quality(F.lit(ideal)) for i, ideal in enumerate(IDEALS)}
    # Measured once per detection; the aggregate only compares and keeps.
    measured = (
        detections.where(F.col("label") != "")
        .withColumn("confidence", g.clamp_unit(F.col("confidence")))
        .withColumns(qualities)
        .withColumn("_operation", F.col(f"_q{IDEALS.index(OPERATION_IDEAL)}"))
    )

    def pick(i: int, ideal: float) -> Column:
        thing = F.struct(
            F.lit(ideal).alias("ideal"), "label", "det_no", "confidence",
            "area", "centroid_x", "centroid_y", "touches_border", *MASK_BOX, "width", "height",
            F.col(f"_q{i}").alias("quality"), F.col("_operation").alias("operation_quality"),
        )
        order = F.struct(-F.col(f"_q{i}"), -F.col("confidence"), "touches_border", "det_no")
        return F.min_by(thing, order)

    return measured.groupBy("frame_id", "label").agg(
        F.array(*[pick(i, ideal) for i, ideal in enumerate(IDEALS)]).alias("best"),
        F.min("det_no").alias("label_place"),
    )


def labels_compatible(query: Column, found: Column) -> Column:
    """Equal, one inside the other, or enough shared words."""
    # Most labels share no word: words are counted only for those that do.
    words = F.split(query, " "), F.split(found, " ")
    q, f = (F.array_distinct(w) for w in words)
    smaller = F.least(F.size(q), F.size(f))
    enough = (smaller <= 2) | (F.size(F.array_intersect(q, f)) / F.greatest(F.lit(1), smaller) >= 0.5)
    return (
        (query == found)
        | F.contains(found, query)
        | F.contains(query, found)
        | (F.arrays_overlap(*words) & enough)
    )


def query_graphs(graphs: DataFrame, synonyms: Mapping[str, str] | None) -> DataFrame:
    """Graphs with mapped labels and effective weights (0 counts as 1)."""
    def weight(x: Column) -> Column:
        value = F.greatest(F.lit(0.0), F.coalesce(x["weight"], F.lit(0.0)))
        return F.when(value > 0, value).otherwise(F.lit(1.0))

    def node(n: Column) -> Column:
        return F.struct(
            n["id"].alias("id"),
            text.normalize_label(n["label"], synonyms).alias("label"),
            n["label"].alias("term"),
            F.coalesce(n["required"], F.lit(False)).alias("required"),
            weight(n).alias("weight"),
        )

    def edge(e: Column) -> Column:
        return F.struct(
            e["from"].alias("from"), e["relation"].alias("relation"), e["to"].alias("to"),
            F.coalesce(e["required"], F.lit(False)).alias("required"), weight(e).alias("weight"),
        )

    return graphs.select(
        "graph_id",
        F.transform("nodes", node).alias("nodes"),
        F.transform("edges", edge).alias("edges"),
    )


def match_nodes(
    pairs: DataFrame,
    graphs: DataFrame,
    detections: DataFrame,
    synonyms: Mapping[str, str] | None = config.LABEL_SYNONYMS,
    max_detections: int = 1_000,
    counted: DataFrame | None = None,
) -> DataFrame:
    """One row per (pair, query node) with its object, if any, and node score.

    pairs: video_id, section_index, frame_id, graph_id, frame_type. Query nodes
    meet their frame's detections directly; frames with more than
    ``max_detections`` of them first shrink to the best object per label.
    ``counted``: rows with frame_id to count instead of the detections.
    """
    rows = _node_rows(pairs, graphs, detections, synonyms, max_detections, counted)
    return rows.select(*PAIR, "node_no", "node", "object", "node_score")


def _node_rows(
    pairs: DataFrame,
    graphs: DataFrame,
    detections: DataFrame,
    synonyms: Mapping[str, str] | None,
    max_detections: int,
    counted: DataFrame | None,
) -> DataFrame:
    """``match_nodes`` with the pair's other columns and its graph's edges.

    They travel with the nodes, so that nothing has to meet the pair again.
    """
    told = [c for c in pairs.columns if c not in PAIR]
    nodes = query_graphs(graphs, synonyms).select(
        "graph_id", "edges", F.posexplode("nodes").alias("node_no", "node")
    )
    asked = (
        pairs.join(nodes, "graph_id")
        .where(F.col("node.label") != "")
        .select(
            *PAIR, "node_no", F.struct("node", "edges", *told).alias("ask"),
            g.ideal_area(F.col("frame_type")).alias("ideal"),
        )
    )
    cold, hot = split_hot(detections, ["frame_id"], max_detections, counted)
    per_label = _label_matches(asked, cold)
    if hot is not None:
        per_label = per_label.unionByName(_hot_matches(asked, best_objects(hot)))

    thing = F.col("object")
    order = F.struct(
        -F.col("bonus"), -thing["quality"], -thing["confidence"],
        thing["touches_border"].cast("int"), F.col("label_place"), thing["det_no"],
    )
    score = g.clamp_unit(
        F.lit(0.50) * thing["quality"] + F.lit(0.30) * thing["confidence"]
        + F.lit(0.20) * F.col("bonus")
    )
    best = F.min_by(
        F.when(thing.isNotNull(), F.struct(thing.alias("object"), F.col("score"))),
        F.when(thing.isNotNull(), order),
    )
    return (
        per_label.withColumn("score", score)
        .groupBy(*PAIR, "node_no")
        .agg(F.first("ask").alias("ask"), best.alias("match"))
        .select(
            *PAIR, "node_no", "ask.*", F.col("match.object").alias("object"),
            F.coalesce("match.score", F.lit(0.0)).alias("node_score"),
        )
    )


THING = ("label", "det_no", "confidence", "area", "centroid_x", "centroid_y", "touches_border",
         *MASK_BOX, "width", "height")


def _bonus() -> Column:
    return F.when(F.col("a.ask.node.label") == F.col("o.label"), F.lit(1.0)).otherwise(F.lit(0.85))


def _fits() -> Column:
    same = F.col("a.frame_id") == F.col("o.frame_id")
    return same & labels_compatible(F.col("a.ask.node.label"), F.col("o.label"))


def _label_matches(asked: DataFrame, detections: DataFrame) -> DataFrame:
    """Best detection per (pair, node, label), straight from the detections."""
    rows = detections.where(F.col("label") != "").select("frame_id", *THING)
    clamped = rows.withColumn("confidence", g.clamp_unit(F.col("confidence")))
    found = (
        asked.alias("a")
        .join(clamped.alias("o"), _fits(), "left")
        .select(
            *[f"a.{c}" for c in PAIR], "a.node_no", "a.ask", "a.ideal", _bonus().alias("bonus"),
            *[f"o.{c}" for c in THING],
        )
        .withColumn("quality", _quality(F.col("ideal")))
        .withColumn("operation_quality", _quality(F.lit(OPERATION_IDEAL)))
    )
    thing = F.struct(*THING, "quality", "operation_quality")
    order = F.struct(-F.col("quality"), -F.col("confidence"), "touches_border", "det_no")
    return found.groupBy(*PAIR, "node_no", "label").agg(
        F.first("ask").alias("ask"),
        F.first("bonus").alias("bonus"),
        F.min("det_no").alias("label_place"),
        F.min_by(F.when(F.col("label").isNotNull(), thing), order).alias("object"),
    )


def _hot_matches(asked: DataFrame, objects: DataFrame) -> DataFrame:
    """The same from objects already reduced to one per (frame, label)."""
    chosen = F.element_at(F.filter("o.best", lambda x: x["ideal"] == F.col("a.ideal")), 1)
    return (
        asked.alias("a")
        .join(objects.alias("o"), _fits())
        .select(
            *[f"a.{c}" for c in PAIR], "a.node_no", "o.label", "a.ask", _bonus().alias("bonus"),
            "o.label_place", chosen.dropFields("ideal").alias("object"),
        )
    )


def _pair_score(l: Column, r: Column, keys: Column) -> Column:
    lbox, rbox = (Box(*[x[m] for m in MASK_BOX]) for x in (l, r))
    overlap = g.overlap_ratio(lbox, rbox)
    distance = g.center_distance(
        l["centroid_x"], l["centroid_y"], r["centroid_x"], r["centroid_y"], l["width"], l["height"]
    )
    related = F.lit(False)
    for relation in ("near", "overlaps"):
        for x, y in ((l, r), (r, l)):
            related = related | F.array_contains(
                keys, F.concat_ws("__", x["label"], F.lit(relation), y["label"])
            )
    return g.pair_spatial(overlap, distance, l["operation_quality"], r["operation_quality"], related)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _weighted(items: Column) -> Column:
    total = _sum(F.transform(items, lambda x: x["weight"]))
    return _sum(F.transform(items, lambda x: x["weight"] * x["score"])) / F.greatest(
        F.lit(1e-6), total
    )


def match_edges(nodes: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row per pair: its node matches in order and its scored edges.

    nodes: ``_node_rows``. Node lists are no longer than the query graph, which
    is one nested value of its section to begin with.
    """
    told = [c for c in nodes.columns if c not in (*PAIR, "node_no", "node", "object", "node_score")]
    item = F.struct("node_no", "node", "object", F.col("node_score").alias("score"))
    listed = nodes.groupBy(*PAIR).agg(
        F.sort_array(F.collect_list(item)).alias("_nodes"),
        F.first(F.struct(*told)).alias("_told"),
    )
    carried = [f"_told.{c}" for c in told]

    def endpoint(node_id: Column) -> Column:
        hit = F.filter("_nodes", lambda n: n["node"]["id"] == node_id)
        return F.try_element_at(hit, F.lit(1))["object"]

    def scored(e: Column) -> Column:
        name = F.concat_ws("__", e["from"], e["relation"], e["to"])

        def judged(ends: Column) -> Column:
            l, r = ends["l"], ends["r"]
            complete = l.isNotNull() & r.isNotNull()
            keys = F.col("relation_keys")
            explicit = F.array_contains(
                keys, F.concat_ws("__", l["label"], e["relation"], r["label"])
            ) | F.array_contains(keys, F.concat_ws("__", r["label"], e["relation"], l["label"]))

            def value(pair: Column) -> Column:
                geometric = e["relation"].isin(*config.GEOMETRIC_RELATIONS)
                bonus = F.when(explicit, F.lit(1.0)).when(geometric, pair).otherwise(F.lit(0.0))
                return g.clamp_unit(F.lit(0.70) * pair + F.lit(0.30) * bonus)

            return F.struct(
                name.alias("name"), e["required"].alias("required"), e["weight"].alias("weight"),
                complete.alias("complete"),
                F.when(complete, bind(_pair_score(l, r, keys), value))
                .otherwise(F.lit(0.0))
                .alias("score"),
            )

        return bind(F.struct(endpoint(e["from"]).alias("l"), endpoint(e["to"]).alias("r")), judged)

    return (
        listed.join(scenes, "frame_id")
        .select(*PAIR, *carried, "_nodes", *[c for c in scenes.columns if c != "frame_id"])
        .withColumn("_edges", F.transform("edges", scored))
        .drop("edges")
    )


def match_score(
    pairs: DataFrame,
    graphs: DataFrame,
    detections: DataFrame,
    scenes: DataFrame,
    synonyms: Mapping[str, str] | None = config.LABEL_SYNONYMS,
    max_detections: int = 1_000,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Score every pair, with each part of the score as a column.

    pairs: video_id, section_index, frame_id, graph_id, frame_type,
    quality_score, and columns passed through. graphs: graph_id, nodes, edges. detections: normalised.
    scenes: ``frame_scenes`` rows; pairs of frames without one are left to
    ``default_match``.
    """
    nodes = _node_rows(pairs, graphs, detections, synonyms, max_detections, counted)
    signs = ["sharp", "not_blurry", "occluded", "labels", "relation_keys", "hand"]
    rows = match_edges(nodes, scenes.select("frame_id", *signs))

    hits = F.filter("_nodes", lambda n: n["object"].isNotNull())
    marks = F.transform(
        "_hits",
        lambda n: F.struct(
            n["object"]["label"].alias("label"),
            *[F.round(n["object"][m], 2).alias(m) for m in MASK_BOX],
        ),
    )
    distinct = F.filter(
        F.transform("_hits", lambda n: n["object"]),
        lambda o, i: F.array_position(
            F.col("_marks"), F.struct(o["label"].alias("label"),
                                      *[F.round(o[m], 2).alias(m) for m in MASK_BOX])
        ) == i + 1,
    )
    pair_scores = F.flatten(
        F.transform(
            "_objects",
            lambda l, i: F.transform(
                F.slice(F.col("_objects"), i + 2, F.size("_objects")),
                lambda r: _pair_score(l, r, F.col("relation_keys")),
            ),
        )
    )
    count = F.size("_objects")
    mean_quality = _sum(F.transform("_objects", lambda o: o["quality"])) / count
    spatial = (
        F.when(F.size("_pairs") > 0, _sum(F.col("_pairs")) / F.size("_pairs"))
        .when(count > 0, mean_quality)
        .otherwise(F.lit(0.0))
    )
    hand = F.col("hand")
    overlaps = F.transform(
        F.filter("_objects", lambda o: o["label"] != "hand"),
        lambda o: g.target_overlap_ratio(
            Box(*[hand[m] for m in MASK_BOX]), Box(*[o[m] for m in MASK_BOX])
        ),
    )
    visible = g.visibility(
        hand.isNotNull(), hand["area"], F.coalesce(F.array_max(overlaps), F.lit(0.0)),
        F.col("occluded"),
    )
    missing_nodes = F.filter("_nodes", lambda n: n["object"].isNull() & n["node"]["required"])
    missing_edges = F.filter("_edges", lambda e: ~e["complete"] & e["required"])
    labels = F.array_union(F.col("labels"), F.transform("_hits", lambda n: n["node"]["label"]))

    node_parts = F.transform(
        "_nodes", lambda n: F.struct(n["node"]["weight"].alias("weight"), n["score"].alias("score"))
    )
    edge_score = F.when(F.size("_edges") > 0, _weighted(F.col("_edges"))).otherwise(F.lit(0.0))

    rows = (
        rows.withColumn("_hits", hits)
        .withColumn("_marks", marks)
        .withColumn("_objects", distinct)
        .withColumn("_pairs", pair_scores)
        .withColumn("_known", labels)
        .withColumn("_terms", F.transform("_nodes", lambda n: n["node"]["term"]))
        .withColumn("node_score", _weighted(node_parts))
        .withColumn("edge_score", edge_score)
        .withColumn("spatial_score", spatial)
        .withColumn("visibility", visible)
        .withColumn("_missing_nodes", missing_nodes)
        .withColumn("_missing_edges", missing_edges)
    )

    def present(name: Column) -> Column:
        """A signal or label the frame shows; names lose their underscores."""
        plain = F.replace(name, F.lit("_"), F.lit(" "))
        underscored = F.transform(
            "_known", lambda x: F.replace(x, F.lit(" "), F.lit("_"))
        )
        return (
            F.array_contains("_known", plain)
            | F.array_contains(underscored, F.replace(plain, F.lit(" "), F.lit("_")))
            | ((plain == "sharp") & F.col("sharp"))
            | ((plain == "occluded") & F.col("occluded"))
        )

    expected = expected_signals(F.col("frame_type"), F.col("_terms"))
    shown = F.size(F.filter(expected, present))
    signal = F.when(F.size(expected) > 0, shown / F.size(expected)).otherwise(F.lit(0.0))
    cut = F.exists("_objects", lambda o: o["touches_border"])
    blurred = ~F.col("not_blurry")
    negatives = [(F.lit(n), present(F.lit(n))) for n in config.NEGATIVE_LABELS]
    matched_any = F.size("_objects") > 0

    def less(hit: Column, amount: Column | float) -> Column:
        return F.when(hit, amount if isinstance(amount, Column) else F.lit(amount)).otherwise(
            F.lit(0.0)
        )

    score = (
        F.lit(0.48) * g.clamp_unit(F.col("node_score"))
        + F.lit(0.32) * g.clamp_unit(F.col("edge_score"))
        + F.lit(0.08) * F.when(matched_any, F.col("visibility")).otherwise(F.lit(0.0))
        + F.lit(0.05) * g.clamp_unit(F.col("quality_score"))
        + F.lit(0.04) * g.clamp_unit(F.col("signal_score"))
        + F.lit(0.03) * g.clamp_unit(F.col("spatial_score"))
        - less(blurred, 0.10)
        - less(F.col("occluded"), F.lit(0.08) + F.lit(0.10) * (F.lit(1.0) - F.col("visibility")))
        - less(cut, 0.04)
    )
    for _, hit in negatives:
        score = score - less(hit, 0.06)
    score = (
        score
        - F.least(F.lit(0.18), F.lit(0.06) * F.size("_missing_nodes"))
        - F.least(F.lit(0.18), F.lit(0.05) * F.size("_missing_edges"))
    )
    negative_hits = F.array_distinct(
        F.array_compact(
            F.array(
                F.when(blurred, F.lit("blur")),
                F.when(F.col("occluded"), F.lit("occluded")),
                F.when(cut, F.lit("border_cut")),
                *[F.when(hit, name) for name, hit in negatives],
            )
        )
    )
    matched = F.array_distinct(
        F.concat(
            F.transform("_hits", lambda n: n["node"]["label"]),
            F.transform(F.filter("_edges", lambda e: e["score"] > 0), lambda e: e["name"]),
        )
    )
    missing = F.array_distinct(
        F.concat(
            F.transform("_missing_nodes", lambda n: n["node"]["label"]),
            F.transform("_missing_edges", lambda e: e["name"]),
        )
    )
    return (
        rows.withColumn("signal_score", signal)
        .withColumn("score", g.clamp_unit(score))
        .select(
            *PAIR, "graph_id", "frame_type", "score", "node_score", "edge_score", "visibility",
            "quality_score", "signal_score", "spatial_score", matched.alias("matched"),
            missing.alias("missing"), negative_hits.alias("negative_hits"),
            *[c for c in pairs.columns if c not in (*PAIR, *PAIR_TOLD)],
        )
    )


def default_match(pairs: DataFrame, graphs: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pairs whose frame has no detector result: score 0, every term missing."""
    terms = graphs.select("graph_id", graph_terms("nodes").alias("missing"))
    empty = F.array().cast("array<string>")
    return (
        pairs.join(scenes.select("frame_id"), "frame_id", "left_anti")
        .join(terms, "graph_id")
        .select(
            *PAIR, "graph_id", "frame_type", F.lit(0.0).alias("score"), empty.alias("matched"),
            "missing", empty.alias("negative_hits"),
        )
    )


def all_matches(scored: DataFrame, defaults: DataFrame) -> DataFrame:
    return scored.unionByName(defaults, allowMissingColumns=True)
