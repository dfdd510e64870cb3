"""A run's results, written once: appended as a whole or not at all, refused or skipped the second time, never read by half.

Under a folder, a run's rows lie in data/run_id=<run>/attempt=<id>, as Spark writes them. What counts is the marker commits/<run>, made after the rows are
written and only if there is none yet; it names the attempt that counts. Readers go by markers, so an attempt that failed, that still runs, or
that lost against another one is not seen, wherever executors were lost. All paths go through Hadoop's file system, so any store that Spark writes
to will do if it can create a file only where there is none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class AlreadyCommitted(Exception):
    """The run has results."""


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text; False if there is one."""
    files, place = _system(spark, path)
    try:
        out = files.create(place, False)
    except Exception as e:  # a failure to create is one of many errors; what counts is whether the file is there
        if files.exists(place):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def committed(spark: SparkSession, path: str) -> dict[int, str]:
    """The attempt that counts, by run."""
    files, place = _system(spark, f"{path}/commits")
    if not files.exists(place):
        return {}
    found = {}
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if name.lstrip("-").isdigit() and status.getLen():
            found[int(name)] = spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(files.open(status.getPath())).decode()
    return found


def append_run(rows: DataFrame, path: str, run_id: int, again: str = "refuse") -> bool:
    """Write the rows of a run (all of them of run_id; others are an error). Is it the first time? again: "refuse" raises AlreadyCommitted otherwise, "skip" leaves
    what is there. The rows aren't computed if the run has results already."""
    spark = rows.sparkSession

    def there() -> bool:
        if again == "refuse":
            raise AlreadyCommitted(f"run {run_id} has results")
        return False

    if run_id in committed(spark, path):
        return there()
    kind = dict(rows.dtypes)["run_id"]
    checked = rows.withColumn("run_id", F.when(F.col("run_id") == run_id, F.col("run_id")).otherwise(F.raise_error(F.lit(f"a row is not of run {run_id}")).cast(kind)))
    attempt = uuid.uuid4().hex
    folder = f"{path}/data/run_id={run_id}/attempt={attempt}"
    checked.write.parquet(folder)
    if _put(spark, f"{path}/commits/{run_id}", attempt):
        return True
    files, place = _system(spark, folder)  # somebody else was first
    files.delete(place, True)
    return there()


def read_runs(spark: SparkSession, path: str, run_ids: list[int] | None = None) -> DataFrame | None:
    """The rows of runs that are whole (all, or those asked for); None if there are none."""
    wanted = {r: a for r, a in committed(spark, path).items() if run_ids is None or r in run_ids}
    if not wanted:
        return None
    return spark.read.parquet(*(f"{path}/data/run_id={r}/attempt={a}" for r, a in sorted(wanted.items())))


def counters(rows: DataFrame, value: list[str]) -> DataFrame:
    """run_id, observations (distinct by value), rows: what is stamped on a run."""
    return rows.groupBy("run_id").agg(F.count_distinct(F.struct(*value)).alias("observations"), F.count(F.lit(1)).alias("rows"))
