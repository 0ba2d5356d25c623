"""Joins beyond equality: ranges, the latest earlier row, the first row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000  #: a side with more is shuffled


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than that."""
    return df.limit(most + 1).count() <= most


def lookup(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "left") -> DataFrame:
    """Equi-join with a dimension: broadcast if its counted rows are few, else a shuffled join."""
    return left.join(F.broadcast(right) if small(right) else right, on, how)


def first_match(left: DataFrame, right: DataFrame, left_key: Column, right_key: str, order: list[Column | str]) -> DataFrame:
    """Left join with the first row in ``order`` of each key; left rows are kept once.

    One row per key is picked by an aggregate (combined before the shuffle), not by a window.
    """
    rest = [c for c in right.columns if c != right_key]
    by = [(F.col(o) if isinstance(o, str) else o).alias(f"_by{i}") for i, o in enumerate(order)]
    best = right.groupBy(right_key).agg(F.min(F.struct(*by, *rest)).alias("_best"))
    best = best.select(F.col(right_key).alias("_key"), *(F.col(f"_best.{c}").alias(c) for c in rest), F.col(right_key).alias(right_key))
    return left.join(F.broadcast(best) if small(right) else best, left_key == F.col("_key"), "left").drop("_key")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, how: str = "left") -> DataFrame:
    """Rows with ``low <= point <= high``, by an equi-join of buckets of ``width``.

    A range stands in each bucket that it touches, a point in one, so no pair is met twice and the
    work follows the matches, not the product. ``width``: about a range's usual length. Columns must
    differ by name. Ranges with low > high or null ends match nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    spread = right.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    dealt = left.withColumn("_bucket", bucket(point))
    condition = (dealt["_bucket"] == spread["_bucket"]) & (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
    return dealt.join(spread, condition, how).drop("_bucket")


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, keep: list[str]) -> DataFrame:
    """Each left row with ``keep`` of the latest right row of the same ``by`` whose time isn't later; null if there is none.

    Both sides go through one shuffle and one ordered window; nothing is multiplied. Ties at one
    time: the greatest of ``keep`` counts. Names of ``keep`` must not be in ``left``.
    """
    value = F.struct(*keep)
    sides = left.select(*by, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_seen"))
    sides = sides.unionByName(
        right.groupBy(*by, F.col(right_at).alias("_at")).agg(F.max(value).alias("_seen")).select(*by, "_at", F.lit(0).alias("_side"), F.lit(None).cast(sides.schema["_row"].dataType).alias("_row"), "_seen")
    )
    before = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = sides.withColumn("_last", F.last("_seen", ignorenulls=True).over(before)).where("_side = 1")
    return found.select(*(F.col(f"_row.{c}").alias(c) for c in left.columns), *(F.col(f"_last.{c}").alias(c) for c in keep))
