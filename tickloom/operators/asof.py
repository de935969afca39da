"""As-of joins as one sort: both sides are unioned and the last (or next) value is carried over.

One exchange and one sort per call, whatever the match distance; no range join. Times are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, *, on: list[str], left_time: Column, right_time: Column, values: list[str], prefix: str = "at_", forward: bool = False, allow_equal: bool = True, keep_time: str | None = None) -> DataFrame:
    """Left rows with the values of the nearest right row before (or after) their time.

    allow_equal says whether a right row of the same time counts. Right rows of one time rank by
    ``seq`` if they have it: the last counts going backward, the first going forward. keep_time names
    a column for the matched row's time. Rows without a match get nulls.
    """
    value = F.struct(*[F.col(c).alias(c) for c in values], right_time.alias("__t"))
    tie = F.col("seq") if "seq" in right.columns else F.lit(0)
    own = F.struct(*[F.col(c) for c in left.columns])
    quote_first = allow_equal != forward  # a quote of the same time sorts before the row it may serve, in scan order
    a = left.select(*on, left_time.alias("__time"), F.lit(1 if quote_first else 0).alias("__order"), F.lit(0).cast("long").alias("__tie"), own.alias("__own"))
    b = right.select(*on, right_time.alias("__time"), F.lit(0 if quote_first else 1).alias("__order"), tie.cast("long").alias("__tie"), value.alias("__value"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("__time", "__order", "__tie")
    near = F.first("__value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("__value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__near", near).where("__own is not null")
    more = [F.col("__near.__t").alias(keep_time)] if keep_time else []
    return out.select("__own.*", *[F.col(f"__near.{c}").alias(prefix + c) for c in values], *more)


def grid(bounds: DataFrame, *, on: list[str], start: str, end: str, step: int) -> DataFrame:
    """Times start, start + step, ... <= end of each row, as ``g``."""
    return bounds.select(*on, F.explode(F.sequence(start, end, F.lit(step).cast("long"))).alias("g"))
