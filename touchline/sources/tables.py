"""Reading and writing the tables: partitioned runs, upserts, deletes, JSON columns, configuration stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_candidates(spark: SparkSession, path: str, asset_ids: list[int] | None = None, run_id: int | None = None, legacy: bool = False) -> DataFrame:
    """Rows of some assets or of a run; legacy: those without a run. The filters reach the files; a run is a folder."""
    df = spark.read.parquet(path)
    if asset_ids is not None:
        df = df.where(F.col("asset_id").isin(asset_ids))
    return df.where(F.col("run_id").isNull()) if legacy else df if run_id is None else df.where(F.col("run_id") == run_id)


def write_run(df: DataFrame, path: str, run_id: int) -> None:
    """Append a run's rows; rows of another run are an error. Nothing that is there is touched."""
    checked = df.withColumn("run_id", F.when(F.col("run_id") == run_id, F.col("run_id")).otherwise(F.raise_error(F.lit(f"a row is not of run {run_id}")).cast(dict(df.dtypes)["run_id"])))
    checked.write.mode("append").partitionBy("run_id").parquet(path)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], updated: str, created: str) -> DataFrame:
    """The latest row of each key, with the first row's creation."""
    rows = base.unionByName(changes)
    w = Window.partitionBy(*keys)
    latest = F.row_number().over(w.orderBy(F.desc(updated)))
    return rows.withColumns({"u_rn": latest, "u_first": F.min(created).over(w)}).where("u_rn = 1").withColumn(created, F.col("u_first")).drop("u_rn", "u_first")


def delete_keys(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def ingest_segments(raw: DataFrame) -> DataFrame:
    """Segments from seconds: blank texts dropped, times as rounded milliseconds (half to even), at least 1 ms long, numbered in order of time."""
    ms = lambda c: F.bround(F.col(c) * 1000).cast("long")
    rows = raw.where(F.trim("text") != "").select("asset_id", F.trim("text").alias("text"), ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"))
    rows = rows.withColumn("end_ms", F.greatest(F.col("start_ms") + 1, "end_ms"))
    w = Window.partitionBy("asset_id").orderBy("start_ms", "end_ms", "text")
    return rows.withColumn("sequence", F.row_number().over(w) - 1)


def to_json_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))


def from_json_columns(df: DataFrame, kinds: dict[str, str], broken: str = "corrupt") -> DataFrame:
    """Columns of JSON text as the types named (DDL), and as `broken` the texts that couldn't be read, by column; their values are null. A null text is a null value."""
    out, bad = df, []
    for name, kind in kinds.items():
        # in an object of one field, which any type can be, and which has room for what doesn't fit
        read = F.from_json(F.concat(F.lit('{"v":'), F.col(name), F.lit("}")), f"v {kind}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
        out = out.withColumn(f"j_{name}", read)
        bad.append(F.when(F.col(f"j_{name}._broken").isNotNull(), F.struct(F.lit(name).alias("column"), F.col(name).alias("text"))))
    out = out.withColumn(broken, F.array_compact(F.array(*bad)))
    values = {name: F.when(F.col(f"j_{name}._broken").isNull(), F.col(f"j_{name}.v")) for name in kinds}
    return out.select(*(values[c].alias(c) if c in kinds else F.col(c) for c in df.columns), broken)


def config_hash(settings: dict) -> Column:
    """SHA-256 of settings, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(F.lit(settings[k]).alias(k) for k in sorted(settings)))), 256)
