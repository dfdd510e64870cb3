"""Operators that depend on order: islands, clusters by gap, thinning, chains, even samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], flag: Column, name: str = "island") -> DataFrame:
    """Rows where flag holds; name is the same number for rows that follow each other without one where it doesn't."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumns({"s_flag": flag, "s_rn": F.row_number().over(w)})
    inside = numbered.where("s_flag").withColumn(name, F.col("s_rn") - F.row_number().over(w))
    return inside.drop("s_flag", "s_rn")


def gap_clusters(df: DataFrame, keys: list[str], ts: str, gap: int, order: list[str] = [], name: str = "cluster") -> DataFrame:  # noqa: B006
    """Rows numbered so that neighbours at most gap apart have one number."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    new = (F.col(ts) - F.lag(ts).over(w) > gap).cast("int")
    return df.withColumn("s_new", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("s_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("s_new")


def thin_by_last_kept(df: DataFrame, keys: list[str], ts: str, gap: int, inclusive: bool, order: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows that come at least gap (inclusive; else more than gap) after the last row kept.

    Rows are cut into islands at larger gaps, across which nothing reaches; islands pass through a task in sorted order. State is the last row kept.
    """
    parts = gap_clusters(df, keys, ts, gap if not inclusive else gap - 1, order, "s_part")
    names, rest = [*keys, "s_part"], [c for c in df.columns if c not in (*keys, ts, *order)]
    key_at, ts_at = [parts.columns.index(c) for c in names], parts.columns.index(ts)

    def run(batches):
        import pyarrow as pa

        island, last = None, None
        for batch in batches:
            keep = []
            for *own, at in zip(*(batch.column(k).to_pylist() for k in (*key_at, ts_at)), strict=True):
                keep.append(island != own or (None not in (at, last) and (at - last >= gap if inclusive else at - last > gap)))
                if keep[-1]:
                    island, last = own, at
            yield batch.filter(pa.array(keep, pa.bool_()))

    return parts.repartition(*names).sortWithinPartitions(*names, ts, *order, *rest).mapInArrow(run, parts.schema).select(*df.columns)


def thin_flags(df: DataFrame, keys: list[str], ts: str, flags: str, gap: int) -> DataFrame:
    """flags (a bit for each of up to 63 kinds) without those of a kind that come less than gap after the last one kept. Rows of a key are in one partition, in
    order of ts. State is the last time kept of each kind."""
    key_at, ts_at, flags_at = [df.columns.index(c) for c in keys], df.columns.index(ts), df.columns.index(flags)

    def run(batches):
        import pyarrow as pa

        key, last = None, {}
        for batch in batches:
            kept = []
            for *own, at, bits in zip(*(batch.column(k).to_pylist() for k in (*key_at, ts_at, flags_at)), strict=True):
                if own != key:
                    key, last = own, {}
                rest, out = bits, 0
                while rest:
                    bit = rest & -rest
                    rest ^= bit
                    if bit not in last or at - last[bit] >= gap:
                        last[bit] = at
                        out |= bit
                kept.append(out)
            yield batch.set_column(flags_at, batch.schema.field(flags_at), pa.array(kept, batch.schema.field(flags_at).type))

    return df.mapInArrow(run, df.schema)


def even_sample(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """At most limit rows by keys, evenly over their order: the first of each of limit equal shares."""
    w = Window.partitionBy(*keys)
    counted = df.withColumns({"s_rn": F.row_number().over(w.orderBy(*order)) - 1, "s_n": F.count(F.lit(1)).over(w)})
    share = f"(s_rn * {limit}) div s_n"
    return counted.where(F.expr(f"s_rn = 0 or {share} <> ((s_rn - 1) * {limit}) div s_n")).drop("s_rn", "s_n")


def centered_median(df: DataFrame, keys: list[str], ts: str, value: str, radius: int, hole: int, name: str) -> DataFrame:
    """name: the median of value over rows farther than hole and at most radius away; null if there is none."""
    w = Window.partitionBy(*keys).orderBy(ts)
    both = F.concat(F.collect_list(value).over(w.rangeBetween(-radius, -hole - 1)), F.collect_list(value).over(w.rangeBetween(hole + 1, radius)))
    out = df.withColumn("s_near", F.sort_array(both)).withColumn("s_n", F.size("s_near"))
    middle = F.expr("case when s_n = 0 then null when s_n % 2 = 1 then s_near[cast(s_n div 2 as int)] else (s_near[cast(s_n div 2 - 1 as int)] + s_near[cast(s_n div 2 as int)]) / 2 end")
    return out.withColumn(name, middle).drop("s_near", "s_n")


def trailing_upper_median(df: DataFrame, keys: list[str], ts: str, value: str, use: Column, radius: int, most: int, name: str) -> DataFrame:
    """name: the upper median of value over the latest rows before, at most most of them and radius back, where use holds; null if there is none."""
    w = Window.partitionBy(*keys).orderBy(ts).rangeBetween(-radius, -1)
    out = df.withColumn("s_near", F.sort_array(F.slice(F.reverse(F.collect_list(F.when(use, F.col(value))).over(w)), 1, most)))
    return out.withColumn(name, F.expr("case when size(s_near) > 0 then s_near[cast(size(s_near) div 2 as int)] end")).drop("s_near")


def back_chain(df: DataFrame, keys: list[str], anchor: str, ts: str, gap: int) -> DataFrame:
    """keys and anchor, and as earliest the ts reached from the anchor by steps back of at most gap over rows up to it."""
    w = Window.partitionBy(*keys, anchor).orderBy(F.desc(ts))
    later = F.coalesce(F.lag(ts).over(w), F.col(anchor))
    broken = F.max((later - F.col(ts) > gap).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.where(F.col(ts) <= F.col(anchor)).withColumn("s_broken", broken).where("s_broken = 0").groupBy(*keys, anchor).agg(F.min(ts).alias("earliest"))
