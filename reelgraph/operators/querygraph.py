"""Query graphs: strict validation, terms and the per-section query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph import config
from reelgraph.functions import responses as r
from reelgraph.functions import text
from reelgraph.functions.rows import bind


def _weight(item: Column) -> Column:
    as_flag = F.try_variant_get(item, "$.weight", "boolean").cast("int").cast("double")
    as_number = F.try_variant_get(item, "$.weight", "double")
    return bind(
        r.kind(r.field(item, "weight")),
        lambda k: F.when(k == "boolean", as_flag).when(k == "number", as_number),
    )


def _node(item: Column) -> Column:
    is_flag = r.kind(r.field(item, "required")) == "boolean"
    return F.struct(
        (r.kind(item) == "object").alias("is_object"),
        text.normalize_id(r.text_field(item, "id")).alias("id"),
        text.normalize_label_plain(r.text_field(item, "label")).alias("label"),
        text.normalize_id(r.text_field(item, "role")).alias("role"),
        F.when(is_flag, F.try_variant_get(item, "$.required", "boolean")).alias("required"),
        _weight(item).alias("weight"),
    )


def _edge(item: Column) -> Column:
    def either(first: str, second: str) -> Column:
        return text.normalize_id(
            text.first_filled(r.text_field(item, first), r.text_field(item, second))
        )

    is_flag = r.kind(r.field(item, "required")) == "boolean"
    return F.struct(
        (r.kind(item) == "object").alias("is_object"),
        either("from", "source").alias("from"),
        either("relation", "type").alias("relation"),
        either("to", "target").alias("to"),
        F.when(is_flag, F.try_variant_get(item, "$.required", "boolean")).alias("required"),
        _weight(item).alias("weight"),
    )


def _common(item: Column, prefix: str, rule: Column) -> Column:
    return (
        rule.when(item["required"].isNull(), F.lit(f"{prefix}_required_not_boolean"))
        .when(item["weight"].isNull(), F.lit(f"{prefix}_weight_not_numeric"))
        .when(item["weight"] < 0, F.lit(f"{prefix}_weight_negative"))
    )


def _first(reasons: Column) -> Column:
    return F.try_element_at(F.array_compact(reasons), F.lit(1))


def validate_query_graphs(df: DataFrame, graph: str) -> DataFrame:
    """Add ``nodes``, ``edges`` (arrays of structs) and ``reason`` (NULL = valid).

    ``graph`` names a JSON text column. Checks run in order of appearance,
    nodes before edges; the first broken rule is the reason. Types are strict:
    ``1`` or ``"true"`` is no boolean, ``"0.5"`` no weight.

    Each graph is read and judged in one expression, whose parts are bound, so that no
    filter or projection above it makes Spark read the text again.
    """
    read = bind(F.try_parse_json(graph), lambda g: F.struct(
        (g.isNull() | (r.kind(g) != "object")).alias("missing"),
        F.transform(r.items(g, "nodes"), _node).alias("nodes"),
        F.transform(r.items(g, "edges"), _edge).alias("edges"),
    ))
    named = bind(read, lambda x: F.struct(
        x["missing"].alias("missing"), x["nodes"].alias("nodes"), x["edges"].alias("edges"),
        F.transform(x["nodes"], lambda n: n["id"]).alias("ids"),
    ))

    def told(x: Column, reason: Column) -> Column:
        return F.struct(
            reason.alias("reason"),
            *[F.when(reason.isNull(), F.transform(x[c], lambda n: n.dropFields("is_object"))).alias(c)
              for c in ("nodes", "edges")],
        )

    judged = bind(named, lambda x: bind(_fault(x), lambda reason: told(x, reason)))
    return df.withColumn("_read", judged).select(*df.columns, "_read.*")


def _fault(graph: Column) -> Column:
    """The first rule that a graph of ``missing``, ``nodes``, ``edges`` and ``ids`` breaks."""

    def node_fault(n: Column, i: Column) -> Column:
        blank = (n["id"] == "") | (n["label"] == "") | (n["role"] == "")
        seen = F.array_position(graph["ids"], n["id"]) <= i
        rule = (
            F.when(~n["is_object"], F.lit("query_graph_node_not_object"))
            .when(blank, F.lit("query_graph_node_incomplete"))
            .when(seen, F.lit("query_graph_node_duplicated"))
        )
        return _common(n, "query_graph_node", rule)

    def edge_fault(e: Column) -> Column:
        blank = (e["from"] == "") | (e["relation"] == "") | (e["to"] == "")
        known = F.array_contains(graph["ids"], e["from"]) & F.array_contains(graph["ids"], e["to"])
        rule = (
            F.when(~e["is_object"], F.lit("query_graph_edge_not_object"))
            .when(blank, F.lit("query_graph_edge_incomplete"))
            .when(~known, F.lit("query_graph_edge_endpoint_unknown"))
        )
        return _common(e, "query_graph_edge", rule)

    return F.coalesce(
        F.when(graph["missing"], F.lit("query_graph_missing")),
        F.when(F.coalesce(F.size(graph["nodes"]), F.lit(0)) <= 0, F.lit("query_graph_nodes_empty")),
        _first(F.transform(graph["nodes"], node_fault)),
        F.when(graph["edges"].isNull(), F.lit("query_graph_edges_not_list")),
        _first(F.transform(graph["edges"], edge_fault)),
    )


def graph_nodes(valid: DataFrame, *keys: str) -> DataFrame:
    return _items(valid, keys, "nodes", "node_no")


def graph_edges(valid: DataFrame, *keys: str) -> DataFrame:
    return _items(valid, keys, "edges", "edge_no")


def _items(valid: DataFrame, keys: Sequence[str], items: str, number: str) -> DataFrame:
    """One row per item. A plain explode would filter on the array first, below what makes it."""
    every = valid.select(*keys, F.posexplode_outer(items).alias(number, "_item"))
    return every.where(F.col(number).isNotNull()).select(*keys, number, "_item.*")


def graph_terms(nodes: Column | str) -> Column:
    """Ordered distinct node labels, without synonyms."""
    source = F.col(nodes) if isinstance(nodes, str) else nodes
    labels = F.transform(source, lambda n: text.normalize_label_plain(n["label"]))
    return F.array_distinct(F.filter(labels, lambda x: x != ""))


def expected_signals(frame_type: Column, terms: Column) -> Column:
    """Signals a frame of this type should show, without the terms themselves."""
    chain = F
    for name, signals in config.EXPECTED_SIGNALS.items():
        chain = chain.when(frame_type == name, F.array(*[F.lit(s) for s in signals]))
    default = F.array(*[F.lit(s) for s in config.EXPECTED_SIGNALS["overview_frame"]])
    return F.array_except(chain.otherwise(default), terms)


def query_spec(
    sections: DataFrame, synonyms: Mapping[str, str] = config.LABEL_SYNONYMS
) -> DataFrame:
    """What to look for in a section's frames.

    sections: title, text, polished_text, business_frame_text, nodes.
    """
    def part(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    title, business = text.strip(part("title")), text.strip(part("business_frame_text"))
    polished = text.strip(part("polished_text"))
    said = F.concat_ws(" ", title, business, part("title"), part("text"))
    asked = F.concat_ws(" ", business, polished, title, part("title"))
    terms = graph_terms("nodes")
    return (
        sections.withColumn("frame_type", text.frame_type(said))
        .withColumn("target", F.coalesce(text.first_filled(business, title), F.lit("")))
        .withColumn("graph_terms", terms)
        .withColumn("query_terms", text.tokenize(asked, synonyms))
        .withColumn("negative_labels", F.array(*[F.lit(x) for x in config.NEGATIVE_LABELS]))
        .withColumn("expected_signals", expected_signals(F.col("frame_type"), F.col("graph_terms")))
    )
