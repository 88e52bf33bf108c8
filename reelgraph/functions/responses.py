"""Reading model responses that arrive as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph.functions.rows import bind, keep_where
from reelgraph.functions.text import first_filled, strip

# --- fixed values -----------------------------------------------------------
FENCE = r"(?is)\A```(?:json)?\s*(.*?)\s*```\s*\z"
BRACES = r"(?s)(\{.*\})"
# --- end of fixed values ----------------------------------------------------


def kind(value: Column) -> Column:
    """JSON kind of a variant: object, array, string, boolean, number or void."""

    def named(schema: Column) -> Column:
        return (
            F.when(schema.startswith("OBJECT"), F.lit("object"))
            .when(schema.startswith("ARRAY"), F.lit("array"))
            .when(schema == "STRING", F.lit("string"))
            .when(schema == "BOOLEAN", F.lit("boolean"))
            .when(schema.isNull() | (schema == "VOID"), F.lit("void"))
            .otherwise(F.lit("number"))
        )

    return bind(F.schema_of_variant(value), named)


def first_present(value: Column, names: Sequence[str]) -> Column:
    """First field that exists and is not a JSON null, as a variant."""
    return F.coalesce(
        *[
            bind(field(value, n), lambda v: F.when(~F.is_variant_null(v), v))
            for n in names
        ]
    )


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def text_field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def items(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "array<variant>")


def chat_content(payload: Column | str) -> Column:
    """Answer text of a chat envelope: message content, else text, else output_text."""
    source = F.col(payload) if isinstance(payload, str) else payload
    return F.coalesce(
        F.get_json_object(source, "$.choices[0].message.content"),
        F.get_json_object(source, "$.choices[0].text"),
        F.get_json_object(source, "$.output_text"),
        F.lit(""),
    )


def model_json(df: DataFrame, content: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the answer's JSON text in ``json``, rows with a ``reason``).

    A code fence is removed first; what does not parse is retried from its
    first ``{`` to its last ``}``. Only objects count.
    """
    body = F.regexp_extract(F.col("_text"), FENCE, 1)
    inner = F.when(F.col("_text").rlike(FENCE), strip(body)).otherwise(F.col("_text"))
    braces = F.regexp_extract(F.col("_inner"), BRACES, 1)
    read = (
        df.withColumn("_text", strip(F.coalesce(F.col(content), F.lit(""))))
        .withColumn("_inner", inner)
        .withColumn("_whole", F.try_parse_json("_inner"))
        .withColumn("_braces", braces)
        .withColumn("_part", F.try_parse_json(F.when(F.col("_braces") != "", F.col("_braces"))))
        .withColumn("_value", F.coalesce("_whole", "_part"))
        .withColumn("json", F.when(F.col("_whole").isNotNull(), F.col("_inner")).otherwise(
            F.col("_braces")
        ))
        .withColumn(
            "reason",
            F.when(F.col("_value").isNull() & (F.col("_braces") == ""), F.lit("not_json"))
            .when(F.col("_value").isNull(), F.lit("malformed_json"))
            .when(kind(F.col("_value")) != "object", F.lit("not_an_object")),
        )
        .drop("_text", "_inner", "_whole", "_braces", "_part", "_value")
    )
    good = keep_where(read, F.col("reason").isNull()).drop("reason")
    return good, keep_where(read, F.col("reason").isNotNull()).drop("json")


def asr_text(payload: Column | str) -> Column:
    """Speech text: its own fields, else the chat answer, else joined sentences."""
    source = F.col(payload) if isinstance(payload, str) else payload
    sentences = items(F.try_parse_json(source), "sentences")
    joined = F.array_join(
        F.transform(
            sentences,
            lambda s: strip(
                F.coalesce(
                    first_filled(*[text_field(s, n) for n in ("text", "transcript", "sentence")]),
                    F.lit(""),
                )
            ),
        ),
        "",
    )
    return strip(
        F.coalesce(
            first_filled(
                F.get_json_object(source, "$.text"),
                F.get_json_object(source, "$.transcription"),
                F.get_json_object(source, "$.choices[0].message.content"),
            ),
            joined,
            F.lit(""),
        )
    )
