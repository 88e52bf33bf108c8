"""Order-dependent primitives that do not put a hot key into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph import config


def split_hot(
    df: DataFrame,
    keys: Sequence[str],
    max_rows: int = config.HOT_GROUP_ROWS,
    counted: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of keys above ``max_rows`` (None if none).

    The check is one map-side combined count over the key columns. At most
    rows / max_rows keys are hot, so the hot key table stays small; Spark
    broadcasts it by its own size threshold. ``counted`` may stand in for ``df``
    where the same keys can be counted more cheaply.
    """
    hot = (df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)
    hot = hot.drop("_n")
    if hot.isEmpty():
        return df, None
    on = [df[k].eqNullSafe(hot[k]) for k in keys]
    condition = on[0]
    for part in on[1:]:
        condition = condition & part
    return df.join(hot, condition, "left_anti"), df.join(hot, condition, "left_semi")


def rank_in_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bin: Column,
    out: str = "rank",
) -> DataFrame:
    """Exact row_number per key for a total order.

    ``bin`` is a number that never falls along the order. Rows are numbered inside their
    (key, bin); each adds the sizes of the earlier bins of its key. Both steps read the
    same exchange, so the input runs once, and a key of any size spreads over its bins.
    """
    rows = df.withColumn("_bin", bin)
    inside = Window.partitionBy(*keys, "_bin")
    numbered = rows.withColumn("_place", F.row_number().over(inside.orderBy(*order)))
    numbered = numbered.withColumn("_size", F.count(F.lit(1)).over(inside))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_key{i}" for i, k in enumerate([*keys, "_bin"])}
    bins = numbered.where(F.col("_place") == 1).select(
        *[F.col(k).alias(n) for k, n in names.items()],
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return (
        numbered.join(bins, same)
        .withColumn(out, (F.col("_place") + F.col("_offset")).cast("bigint"))
        .drop("_place", "_size", "_offset", "_bin", *names.values())
    )


def previous_and_running_max(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    block_rows: int,
    running: str = "running_max",
    previous: str = "previous_max",
) -> DataFrame:
    """Running maximum of ``value`` by integer ``position`` within each key, and
    the running maximum up to the row before.

    Two levels: inside blocks of ``block_rows`` positions, then over one row per
    block, so a key of any length is spread over its blocks.
    """
    block = F.floor(F.col(position) / block_rows)
    rows = df.withColumn("_value", value).withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(position)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(*keys, "_block")
        .agg(F.max("_value").alias("_top"))
        .withColumn(
            "_carry",
            F.max("_top").over(
                Window.partitionBy(*keys)
                .orderBy("_block")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_top")
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_run", F.max("_value").over(upto))
        .withColumn("_prev", F.max("_value").over(before))
        .join(blocks, [*keys, "_block"])
        .withColumn(running, F.greatest("_run", "_carry"))
        .withColumn(previous, F.greatest("_prev", "_carry"))
        .drop("_value", "_block", "_run", "_prev", "_carry")
    )


def offset_and_total(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, block_rows: int
) -> DataFrame:
    """Add ``offset`` (sum of ``value`` before the row) and ``total`` per key,
    by the same two levels as ``previous_and_running_max``."""
    rows = df.withColumn("_value", value).withColumn(
        "_block", F.floor(F.col(position) / block_rows)
    )
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(*before)
    per_key = Window.partitionBy(*keys)
    blocks = (
        rows.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn(
            "_carry",
            F.coalesce(F.sum("_sum").over(per_key.orderBy("_block").rowsBetween(*before)), F.lit(0)),
        )
        .withColumn("total", F.sum("_sum").over(per_key))
        .drop("_sum")
    )
    local = F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return (
        rows.withColumn("_local", local)
        .join(blocks, [*keys, "_block"])
        .withColumn("offset", F.col("_local") + F.col("_carry"))
        .drop("_value", "_block", "_local", "_carry")
    )


def ordered_parts(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    line: Column,
    separator: str,
    out: str,
    part_rows: int = config.PART_ROWS,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Ordered text per key in parts of ``part_rows`` positions.

    A key with fewer positions has the single part 0; a longer one continues in
    further parts, which concatenate to the whole text in part order.
    """
    items = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), line.alias("t"))))
    return (
        df.withColumn("part_no", F.floor(F.col(position) / part_rows))
        .groupBy(*keys, "part_no")
        .agg(F.array_join(F.transform(items, lambda x: x["t"]), separator).alias(out), *extra)
    )
