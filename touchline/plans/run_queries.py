"""Queries of writing and reading: runs that are committed once, JSON that comes back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.plans.registry import Tables, query
from touchline.sources import runs as RUNS
from touchline.sources import tables as IO

VALUE = ["asset_id", "ts_ms", "signal_type", "event_type", "confidence", "evidence"]


def shared_folder(df: DataFrame) -> str:
    """A new folder below the one that the cluster shares; in local mode without that setting, a temporary one."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="runs-")
    return f"{base.rstrip('/')}/runs-{uuid.uuid4().hex}"


@query("s2_append_runs", needs=("moments",), sql=f"""select run_id, count(distinct ({", ".join(VALUE)})) as observations, count(*) as rows from moments group by run_id""")
def s2(t: Tables):
    """Each run is written twice; the second time changes nothing."""
    signals = t("moments")
    path = shared_folder(signals)
    for run_id in (r.run_id for r in signals.select("run_id").distinct().collect()):  # runs of the fixture, two
        for _ in range(2):
            RUNS.append_run(signals.where(F.col("run_id") == run_id), path, run_id, again="skip")
    return RUNS.counters(RUNS.read_runs(signals.sparkSession, path), VALUE)


@query("s6_signals_from_json", needs=("signals",), sql="""select asset_id, run_id, count(*) as n, max(confidence) as top, false as broken from signals group by asset_id, run_id having (asset_id * 2 + run_id) % 7 <> 3
union all select asset_id, run_id, null, null, true from signals group by asset_id, run_id having (asset_id * 2 + run_id) % 7 = 3""")  # fmt: skip
def s6(t: Tables):
    """Signals of a run as JSON, every seventh text cut off, read back."""
    nested = t("signals").groupBy("asset_id", "run_id").agg(F.sort_array(F.collect_list(F.struct("id", "signal_type", "confidence"))).alias("signals"))
    text = IO.to_json_columns(nested)
    cut = F.expr("left(signals, length(signals) - 3)")
    text = text.withColumn("signals", F.when((F.col("asset_id") * 2 + F.col("run_id")) % 7 == 3, cut).otherwise(F.col("signals")))
    read = IO.from_json_columns(text, {"signals": "array<struct<id:bigint,signal_type:string,confidence:double>>"})
    top = F.array_max(F.transform("signals", lambda s: s["confidence"]))
    return read.select("asset_id", "run_id", F.when(F.col("signals").isNotNull(), F.size("signals")).cast("long").alias("n"), top.alias("top"), (F.size("corrupt") > 0).alias("broken"))
