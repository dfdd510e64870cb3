"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of a batch that per_row() gives.
MOST_ROWS, MOST_BYTES = 512, 8 << 20
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: the session's spark.checkpoint.dir. Without that setting a local session gets a new temporary folder;
    a cluster has none that its machines share, so there it is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return tempfile.mkdtemp(prefix="checkpoint-")


#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut. The shuffle files behind it are removed: nothing reads them again."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, True)
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(CLEANUP, before)


def unused(base: str, *tables: DataFrame) -> str:
    """A column name that no table has, in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while base.lower() in taken:
        base += "_"
    return base


def spread_join(rows: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with few on key, of which few has each value once, so that rows of one frequent key are dealt over many tasks.

    Rows are joined on key and a part of the hash of the column `by`; few is first spread over the parts that rows have, once each.
    """
    part = unused("s_part", rows, few)
    parts = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    return dealt.join(dealt.select(key, part).distinct().join(few, key), [key, part], how).drop(part)


def per_row(columns: list[str], out: pa.Schema, make: Callable[[], Callable[..., tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that turns each row into one row.

    make() runs once a task and returns a function of the named columns' values; its tuple has the fields of out. Rows leave when there are
    MOST_ROWS of them or their texts and bytes are over MOST_BYTES, so beside the batch of input a task holds that and one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            cells = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            rows, size = [], 0
            for k in range(batch.num_rows):
                rows.append(f(*(c[k].as_py() for c in cells)))
                size += sum(len(v) for v in rows[-1] if isinstance(v, str | bytes))
                if len(rows) >= MOST_ROWS or size > MOST_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows, size = [], 0

    return run


def spark_schema(out: pa.Schema) -> str:
    """The DDL string of an Arrow schema of simple types."""
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in out)
