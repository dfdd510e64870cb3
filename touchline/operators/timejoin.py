"""Joins on a time axis: ranges, overlaps, as-of, fences.

Catalyst makes an equi join on the recording with the range as a residual test, which looks at every pair of a recording. Here the axis is cut
into buckets, so a row meets only rows of its own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, keys: list[str], lo: Column, hi: Column, ts: str, width: int, how: str = "inner") -> DataFrame:
    """Rows of left with rows of right of the same keys whose ts lies in [lo, hi] (columns of left). Other names of the two must differ.

    left is listed in each bucket its range touches, right in one, so no pair comes twice. how: inner, left, left_semi or left_anti; all
    but inner look for each range of left once and join what was found by keys and range, so equal rows stay equal rows. (Row numbers given by Spark won't do
    for that: left is computed twice, and its rows may come in another order.)
    """
    points = right.withColumns({"t_bucket": F.floor(F.col(ts) / F.lit(width))})
    for k in keys:
        points = points.withColumnRenamed(k, f"t_{k}")
    rows = left.withColumns({"t_lo": lo, "t_hi": hi})
    near = rows if how == "inner" else rows.select(*keys, "t_lo", "t_hi").distinct()
    near = near.withColumn("t_bucket", F.explode(F.expr(f"if(t_hi >= t_lo, sequence(floor(t_lo / {width}), floor(t_hi / {width})), array())")))
    on = [near[k] == points[f"t_{k}"] for k in keys] + [near["t_bucket"] == points["t_bucket"], F.col(ts).between(F.col("t_lo"), F.col("t_hi"))]
    drop = ["t_lo", "t_hi", *(f"t_{k}" for k in keys)]
    if how == "inner":
        return near.join(points, on).drop(points["t_bucket"]).drop("t_bucket", *drop)
    by = [*keys, "t_lo", "t_hi"]
    found = near.join(points, on).select(*by, *(c for c in right.columns if c not in keys))
    return rows.join(found if how == "left" else found.select(*by).distinct(), by, how).select(*left.columns, *(c for c in found.columns if how == "left" and c not in by))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows of the same keys whose half-open intervals overlap: a.start < b.end and b.start < a.end. A pair that shares several buckets is
    kept in the first of them."""
    span = lambda x: F.expr(f"sequence(floor({x[0]} / {width}), floor({x[1]} / {width}))")
    other = right
    for k in keys:
        other = other.withColumnRenamed(k, f"t_{k}")
    one, two = left.withColumn("t_one", F.explode(span(a))), other.withColumn("t_two", F.explode(span(b)))
    first = F.greatest(F.floor(F.col(a[0]) / F.lit(width)), F.floor(F.col(b[0]) / F.lit(width)))
    on = [one[k] == two[f"t_{k}"] for k in keys] + [F.col("t_one") == F.col("t_two")]
    overlap = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col("t_one") == first)
    return one.join(two, on).where(overlap).drop("t_one", "t_two", *(f"t_{k}" for k in keys))


def asof_last(left: DataFrame, right: DataFrame, keys: list[str], ts: str, right_ts: str, columns: list[str], order: list[str] = []) -> DataFrame:  # noqa: B006
    """left with columns of the latest row of right at or before its ts (ties in right: the last by order), by one sort of both."""
    marks = right.select(*keys, F.col(right_ts).alias("t_ts"), F.lit(0).alias("t_side"), *(F.col(o).alias(f"t_o{i}") for i, o in enumerate(order)), F.struct(*columns).alias("t_found"))
    rows = left.select(*keys, F.col(ts).alias("t_ts"), F.lit(1).alias("t_side"), F.struct(*left.columns).alias("t_row"))
    w = Window.partitionBy(*keys).orderBy("t_ts", "t_side", *(f"t_o{i}" for i in range(len(order)))).rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(rows, allowMissingColumns=True).withColumn("t_last", F.last("t_found", ignorenulls=True).over(w)).where("t_side = 1")
    return both.select("t_row.*", *(F.col(f"t_last.{c}").alias(c) for c in columns))


def nearest(pairs: DataFrame, by: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Of the pairs of each left row (by) the one with the least order."""
    return pairs.groupBy(*by).agg(F.min_by(F.struct(*columns), order).alias("t_best")).select(*by, "t_best.*")


def fence_counts(rows: DataFrame, fences: DataFrame, keys: list[str], ts: str, fence_ts: str, strict: bool, name: str) -> DataFrame:
    """rows and, as name, the fences of their keys up to ts (strict: before it). Nothing lies strictly between t1 and t2 if the count up to t1 equals the
    count before t2."""
    marks = fences.select(*keys, F.col(fence_ts).alias("t_ts"), F.lit(1 if strict else 0).alias("t_side"), F.lit(1).alias("t_one"))
    own = rows.select(*keys, F.col(ts).alias("t_ts"), F.lit(0 if strict else 1).alias("t_side"), F.struct(*rows.columns).alias("t_row"))
    w = Window.partitionBy(*keys).orderBy("t_ts", "t_side").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(own, allowMissingColumns=True).withColumn(name, F.coalesce(F.sum("t_one").over(w), F.lit(0)))
    return both.where("t_row is not null").select("t_row.*", name)
