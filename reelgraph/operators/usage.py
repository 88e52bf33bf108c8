"""Model-usage ledger: token extraction, classification and roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph import config

# --- fixed values -----------------------------------------------------------
PROMPT_KEYS = ("prompt_tokens", "input_tokens", "promptTokens", "inputTokens")
COMPLETION_KEYS = ("completion_tokens", "output_tokens", "completionTokens", "outputTokens")
TOTAL_KEYS = ("total_tokens", "totalTokens")
FEATURES = (config.FEATURE_TRANSCRIPT, config.FEATURE_KEYFRAMES, config.FEATURE_MARKDOWN)
# --- end of fixed values ----------------------------------------------------


def _first_count(response: Column, keys: tuple[str, ...]) -> Column:
    """First value readable as a whole number, not below 0.

    The JSON kind decides: numbers are cut, text must be a whole number, booleans are
    0 or 1; anything else leaves the choice to the next key.
    """
    parsed = F.try_parse_json(response)

    def readable(key: str) -> Column:
        value = F.try_variant_get(parsed, f"$.usage.{key}", "variant")
        shown = F.get_json_object(response, f"$.usage.{key}")
        kind = F.schema_of_variant(value)
        whole = F.when(shown.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(shown).try_cast("bigint"))
        return (
            F.when(kind == "STRING", whole)
            .when(kind == "BOOLEAN", (shown == "true").cast("bigint"))
            .when(kind == "BIGINT", shown.try_cast("bigint"))
            .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), shown.try_cast("decimal(38,18)").try_cast("bigint"))
        )

    found = F.coalesce(*[readable(key) for key in keys])
    return F.when(found.isNotNull(), F.greatest(F.lit(0).cast("bigint"), found))


def usage_tokens(response: Column | str) -> dict[str, Column]:
    """prompt, completion and total token columns of a JSON response."""
    source = F.col(response) if isinstance(response, str) else response
    zero = F.lit(0).cast("bigint")
    prompt = F.coalesce(_first_count(source, PROMPT_KEYS), zero)
    completion = F.coalesce(_first_count(source, COMPLETION_KEYS), zero)
    total = F.coalesce(_first_count(source, TOTAL_KEYS), prompt + completion)
    return {"prompt_tokens": prompt, "completion_tokens": completion, "total_tokens": total}


def classify_calls(calls: DataFrame) -> DataFrame:
    """Add ``feature_name`` and ``model``; calls outside the ledger are dropped.

    Needs interface_type, tool_or_endpoint, mode, request_model, response_model.
    """
    endpoint, mode = F.col("tool_or_endpoint"), F.col("mode")
    parent = (F.col("interface_type") == "background") & (endpoint == config.PARSE_ENDPOINT)
    feature = (
        F.when(endpoint.isin(*config.TRANSCRIPT_MODEL_CALLS), F.lit(config.FEATURE_TRANSCRIPT))
        .when(parent & (mode == "transcript"), F.lit(config.FEATURE_TRANSCRIPT))
        .when(parent & (mode == "keyframes"), F.lit(config.FEATURE_KEYFRAMES))
        .when(parent & (mode == "markdown"), F.lit(config.FEATURE_MARKDOWN))
    )
    parse = endpoint == config.PARSE_ENDPOINT
    local = (
        F.when(
            parse & (mode == "transcript"),
            F.lit(f"{config.ASR_MODEL_LABEL} + {config.STRUCTURE_MODEL}"),
        )
        .when(parse & (mode == "keyframes"), F.lit(config.KEYFRAME_MODEL_LABEL))
        .when(parse & (mode == "markdown"), F.lit(config.MARKDOWN_MODEL_LABEL))
        .otherwise(F.lit(config.LOCAL_MODEL_LABEL))
    )
    named = [F.when(F.col(c) != "", F.col(c)) for c in ("response_model", "request_model")]
    return (
        calls.withColumn("feature_name", feature)
        .where(F.col("feature_name").isNotNull())
        .withColumn("model", F.coalesce(*named, local))
    )


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Parents with their own tokens, or the sum over their model calls if none.

    Children name their parent in ``parent_call_id`` and share its video and
    feature, not starting before it. Children are summed per parent and start
    time before they meet the parent row, so a parent with very many calls is
    combined ahead of the shuffle.
    """
    tokens = ("prompt_tokens", "completion_tokens", "total_tokens")
    parent = (F.col("interface_type") == "background") & (
        F.col("tool_or_endpoint") == config.PARSE_ENDPOINT
    )
    children = (
        usage.where((F.col("interface_type") == "model") & F.col("parent_call_id").isNotNull())
        .groupBy("parent_call_id", "video_id", "feature_name", "created_at")
        .agg(*[F.sum(F.coalesce(t, F.lit(0))).alias(f"_{t}") for t in tokens])
    )
    parents = usage.where(parent)
    p, c = parents.alias("p"), children.alias("c")
    sums = (
        p.join(
            c,
            (F.col("p.id") == F.col("c.parent_call_id"))
            & F.col("p.video_id").eqNullSafe(F.col("c.video_id"))
            & (F.col("p.feature_name") == F.col("c.feature_name"))
            & (F.col("c.created_at") >= F.col("p.created_at")),
        )
        .groupBy(F.col("p.id").alias("id"))
        .agg(*[F.sum(f"c._{t}").alias(f"_{t}") for t in tokens])
    )
    joined = parents.join(sums, "id", "left")
    own = F.coalesce(F.col("total_tokens"), F.lit(0)) > 0
    rolled = {
        f"{t}_out": F.when(own, F.coalesce(F.col(t), F.lit(0))).otherwise(
            F.coalesce(F.col(f"_{t}"), F.lit(0))
        )
        for t in tokens
    }
    result = joined.withColumns(rolled).drop(*tokens, *[f"_{t}" for t in tokens])
    return result.withColumnsRenamed({f"{t}_out": t for t in tokens})


def usage_summary(rolled: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """The public ledger: known features with labels and defaults."""
    label = F
    for status, name in config.USAGE_STATUS_LABELS.items():
        label = label.when(F.col("status") == status, F.lit(name))
    model = F.when(F.col("model") != "", F.col("model"))
    return (
        rolled.where(
            (F.col("interface_type") == "background")
            & (F.col("tool_or_endpoint") == config.PARSE_ENDPOINT)
            & F.col("feature_name").isin(*features)
        )
        .withColumn("model", F.coalesce(model, F.lit(config.LOCAL_MODEL_LABEL)))
        .withColumn("status_label", label.otherwise(F.lit(config.USAGE_STATUS_DEFAULT)))
        .orderBy(F.col("created_at").desc(), F.col("id").desc())
    )


def usage_search(
    summary: DataFrame, model: str = "", feature: str = "", status: str = ""
) -> DataFrame:
    """Ledger rows of a feature and a status whose model mentions ``model``."""
    if feature:
        summary = summary.where(F.col("feature_name") == feature)
    if status:
        summary = summary.where(F.col("status") == status)
    return summary.where(F.contains(F.lower("model"), F.lower(F.lit(model.strip()))))


def usage_total(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
    )
