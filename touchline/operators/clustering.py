"""Detections of one event as one: clusters with rules that forbid a merge, replays as support, and the merged event.

candidates: asset_id, run_id, candidate_id, event_type, trigger_ms, start_ms, end_ms, score, status, context. signals: candidate_id and what each candidate is
stored with (signal_type, event_type, confidence, ts_ms, evidence).

What two candidates are compared by is computed by Spark, a row a candidate; which live goals a replay tells the same as is a set-similarity join. Only
the assignment depends on what came before; it goes through a task in order of time, by recording, run and event type, which clusters never mix;
other types than goals are cut where triggers are farther apart than a cluster can be. The state of that fold is what can still be joined.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as X
from touchline.operators import similarity as L
from touchline.operators.lineage import settled
from touchline.settings import DEFAULTS, Settings

KEY = ["asset_id", "run_id"]
BURSTS = ("AUDIO_SPIKE", "AUDIO_SUSTAINED", "VOICE_EXCITEMENT", "PITCH_RISE", "PITCH_VARIANCE", "CROWD_REACTION_PROXY")
CARDS = ("YELLOW_CARD", "RED_CARD")
# Words that don't tell which goal a text is about, as the clusters count them.
IDENTITY_STOP_WORDS = ("goal", "goals", "score", "scores", "scored", "replay", "crowd", "team", "match", "but", "marque", "marquer", "egalisation")
PHRASE = "Football phrase match: "
LIVE_HYPOTHESIS = "Inferred live goal hypothesis"
#: How good a start is, by its reason.
START_QUALITY = {"START=PENALTY_SETUP": 5, "START=BUILDUP_SIGNAL": 4, "START=ATTACK_INTENSITY_RISE": 3, "START=DECISIVE_ACTION": 2}


@dataclass(frozen=True)
class Windows:
    goal_ms: int = 15_000
    card_ms: int = 20_000
    shot_ms: int = 3000
    other_ms: int = 10_000
    similarity: float = 0.48
    strong_goal: float = 0.70

    def of(self, kind: str) -> int:
        return self.goal_ms if kind == "GOAL" else self.card_ms if kind in CARDS else self.shot_ms if kind in ("SHOT", "NEAR_MISS") else self.other_ms

    def column(self) -> Column:
        kind = F.col("event_type")
        return F.when(kind == "GOAL", self.goal_ms).when(kind.isin(*CARDS), self.card_ms).when(kind.isin("SHOT", "NEAR_MISS"), self.shot_ms).otherwise(self.other_ms)


def identity(words: Column) -> Column:
    return F.filter(words, lambda x: (F.char_length(x) >= 4) & ~x.isin(*IDENTITY_STOP_WORDS))


def features(candidates: DataFrame, signals: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """candidates with what they are compared by: action_ms, transitions (time and text of new scores), results and scores named, phrases, bursts (times, in order), cue (is
    there a replay cue?), moved (a new score within 30 s), l_class and words."""
    kind, said, ts = F.col("signal_type"), F.col("evidence"), F.col("ts_ms")
    rows = signals.join(candidates.select("candidate_id", "trigger_ms"), "candidate_id")
    inferred = (F.col("event_type") == "GOAL") & ((kind == "AUDIO_GOAL_HYPOTHESIS") | ((kind == "TRANSCRIPT_GOAL") & said.contains(LIVE_HYPOTHESIS)))
    change = kind == "SCORE_STATE_TRANSITION"
    own = ~said.startswith("Replay probability includes") & ~said.startswith("Goal candidate repeats nearby")
    sets = lambda value: F.array_sort(F.array_distinct(F.flatten(F.collect_set(value))))
    one = rows.groupBy("candidate_id").agg(
        F.min(F.when((kind == "EVENT_RECONSTRUCTION") & (F.col("event_type") == "GOAL"), ts)).alias("built_ms"),
        F.min(F.when((kind == "TRANSCRIPT_SHOT") & (F.col("event_type") == "SHOT"), ts)).alias("shot_ms"),
        F.bool_or(inferred).alias("inferred"),
        F.array_sort(F.collect_set(F.when(change, F.concat(ts.cast("string"), F.lit(" "), said)))).alias("transitions"),
        sets(F.when(change, F.regexp_extract_all(said, F.lit(r"(?i)\bto\s+(\d{1,2}-\d{1,2})\b"), F.lit(1)))).alias("results"),
        sets(F.when(kind.isin("SCORE_STATE", "SCORE_STATE_TRANSITION"), F.regexp_extract_all(said, F.lit(r"\b(\d{1,2}-\d{1,2})\b"), F.lit(1)))).alias("scores"),
        F.array_sort(F.collect_set(F.when((kind == "TRANSCRIPT_KEYWORD") & said.startswith(PHRASE), X.normalize_text(F.expr(f"substring(evidence, {len(PHRASE) + 1})"))))).alias("phrases"),
        F.array_sort(F.collect_set(F.when(kind.isin(*BURSTS), ts))).alias("bursts"),
        F.bool_or(kind.isin("REPLAY_CONTEXT", "RETROSPECTIVE_CONTEXT") & own & (F.col("confidence") >= cfg.replay_probability)).alias("cue"),
        F.bool_or(change & (ts - F.col("trigger_ms")).between(0, 30_000)).alias("moved"),
    )
    out = candidates.join(one, "candidate_id", "left")
    action = F.coalesce("built_ms", F.when(F.col("inferred"), F.col("shot_ms")))
    none = {c: F.coalesce(c, F.expr(f"cast(array() as array<{'bigint' if c == 'bursts' else 'string'}>)")) for c in ("transitions", "results", "scores", "phrases", "bursts")}
    out = out.withColumns({"action_ms": action, **none, "cue": F.coalesce("cue", F.lit(False)), "moved": F.coalesce("moved", F.lit(False))}).drop("built_ms", "shot_ms", "inferred")
    return L.classes(out, "context", "content")


@dataclass
class Cluster:
    first: int
    start_ms: int
    members: list[dict] = field(default_factory=list)
    live: dict | None = None  # the last strong live goal


def similarity(a: dict, b: dict) -> float:
    return len(a["words"] & b["words"]) / len(a["words"] | b["words"]) if a["words"] and b["words"] else 0.0


def same_action(a: dict, b: dict, w: Windows) -> bool:
    if a["action_ms"] is not None and b["action_ms"] is not None and abs(a["action_ms"] - b["action_ms"]) <= 3000:
        return True
    return bool(a["transitions"] & b["transitions"]) and similarity(a, b) >= max(0.65, w.similarity)


def burst_near(a: list[int], b: list[int], reach: int = 1500) -> bool:
    """Is any time of a near one of b? Both in order."""
    for t in a:
        k = bisect_left(b, t - reach)
        if k < len(b) and b[k] <= t + reach:
            return True
    return False


def same_event(a: dict, b: dict, w: Windows) -> bool:
    """Are two candidates of one type one event?"""
    gap = abs(a["trigger_ms"] - b["trigger_ms"])
    if a["event_type"] == "GOAL":
        if a["results"] and b["results"] and not a["results"] & b["results"]:
            return False  # other scores came of them
        return same_action(a, b, w) or gap == 0
    if gap > w.of(a["event_type"]) or a["end_ms"] < b["start_ms"] or b["end_ms"] < a["start_ms"]:
        return False
    if gap == 0:
        return True
    alike, phrase = similarity(a, b), bool(a["phrases"] & b["phrases"])
    if (gap <= 3000 and alike >= w.similarity) or (phrase and gap <= 5000 and alike >= w.similarity * 0.55) or (phrase and alike >= max(0.80, w.similarity)):
        return True
    return a["event_type"] in CARDS and alike >= w.similarity * 0.7 and burst_near(a["bursts"], b["bursts"])


class Fold:
    """Candidates of one recording, run and type in order of time, to their clusters. Clusters that no later candidate can join are dropped: of other types
    those that begin too early; goals are found by time, by the time of their action and by new scores."""

    def __init__(self, kind: str, w: Windows):
        self.kind, self.w = kind, w
        self.recent: list[int] = []  # numbers of clusters within reach by time
        self.clusters: dict[int, Cluster] = {}
        self.by_action: dict[int, set[int]] = {}
        self.by_change: dict[str, set[int]] = {}
        self.by_class: dict[str, set[int]] = {}
        self.count = 0

    def reachable(self, c: dict) -> list[int]:
        at, window = c["trigger_ms"], self.w.of(self.kind)
        late = [n for n in self.recent if at - self.clusters[n].start_ms > window]
        self.recent = [n for n in self.recent if at - self.clusters[n].start_ms <= window]
        if self.kind != "GOAL":
            for n in late:
                del self.clusters[n]
            return self.recent
        found = set(self.recent)
        if c["action_ms"] is not None:
            bucket = c["action_ms"] // 3000
            found.update(n for k in (bucket - 1, bucket, bucket + 1) for n in self.by_action.get(k, ()))
        for change in c["transitions"]:
            found |= self.by_change.get(change, set())
        return sorted(found)

    def join(self, n: int, c: dict) -> None:
        cluster = self.clusters[n]
        cluster.members.append(c)
        if self.kind == "GOAL":
            if c["action_ms"] is not None:
                self.by_action.setdefault(c["action_ms"] // 3000, set()).add(n)
            for change in c["transitions"]:
                self.by_change.setdefault(change, set()).add(n)
            if c["detected"] and c["score"] >= self.w.strong_goal:
                if cluster.live is not None:
                    self.by_class[cluster.live["l_class"]].discard(n)
                cluster.live = c
                self.by_class.setdefault(c["l_class"], set()).add(n)

    def detected(self, c: dict) -> int:
        for n in reversed(self.reachable(c)):
            cluster = self.clusters[n]
            near = c["trigger_ms"] - cluster.start_ms <= self.w.of(self.kind)
            if (near or any(same_action(c, m, self.w) for m in cluster.members)) and all(same_event(c, m, self.w) for m in cluster.members):
                self.join(n, c)
                return cluster.first
        n, self.count = self.count, self.count + 1
        self.clusters[n] = Cluster(c["candidate_id"], c["trigger_ms"])
        self.recent.append(n)
        self.join(n, c)
        return c["candidate_id"]

    def replayed(self, c: dict) -> int:
        """The cluster whose goal a rejected goal tells the same as: the most alike, then one with the same score, then the latest."""
        best = None
        for cls, alike in c["like"]:
            for n in self.by_class.get(cls, ()):
                live = self.clusters[n].live
                if live["trigger_ms"] < c["trigger_ms"]:
                    rank = (alike, bool(live["scores"] & c["scores"]), live["trigger_ms"], n)
                    best = max(best or rank, rank)
        if best is None:
            return c["candidate_id"]
        self.join(best[-1], c)  # later goals must be the same event as this one, too
        return self.clusters[best[-1]].first


COLUMNS = ["group", "event_type", "candidate_id", "trigger_ms", "start_ms", "end_ms", "score", "detected", "asks", "action_ms", "transitions", "results", "scores", "phrases", "bursts", "words", "l_class", "like"]
CLUSTERED = pa.schema([("candidate_id", pa.int64()), ("cluster_id", pa.int64())])


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for row in batch.to_pylist():
            for c in ("transitions", "results", "scores", "phrases", "words"):
                row[c] = frozenset(row[c])
            row["like"] = [(x["r_class"], x["jaccard"]) for x in row["like"] or ()]
            yield row


def _fold(w: Windows):
    def run(batches):
        found = []
        for (_, kind), own in groupby(_rows(batches), key=itemgetter("group", "event_type")):
            fold = Fold(kind, w)
            for c in own:
                found.append((c["candidate_id"], fold.detected(c) if c["detected"] else fold.replayed(c) if c["asks"] else c["candidate_id"]))
                if len(found) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], schema=CLUSTERED)
                    found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], schema=CLUSTERED)

    return run


def cluster_events(candidates: DataFrame, signals: DataFrame, cfg: Settings = DEFAULTS, w: Windows = Windows()) -> DataFrame:
    """candidate_id, cluster_id (its first member) of every candidate."""
    rows = settled(features(candidates, signals, cfg).withColumns({"detected": F.col("status") == "DETECTED", "asks": (F.col("status") != "DETECTED") & (F.col("event_type") == "GOAL") & F.col("cue") & ~F.col("moved")}))
    live = rows.where((F.col("event_type") == "GOAL") & F.col("detected") & (F.col("score") >= w.strong_goal))
    pairs = L.similar_classes(rows.where("asks"), live, KEY, max(0.70, w.similarity), 3, identity)
    like = pairs.groupBy(*KEY, "l_class").agg(F.collect_list(F.struct("r_class", "jaccard")).alias("like"))
    rows = rows.join(like, [*KEY, "l_class"], "left")
    # other types than goals: no cluster spans a gap wider than its window
    order = Window.partitionBy(*KEY, "event_type").orderBy("trigger_ms", "candidate_id")
    gap = (F.col("event_type") != "GOAL") & (F.col("trigger_ms") - F.lag("trigger_ms").over(order) > w.column())
    rows = rows.withColumn("part", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("part", F.sum("part").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("group", F.struct(*KEY, "event_type", "part").cast("string")).select(*COLUMNS)
    return rows.repartition("group").sortWithinPartitions("group", "trigger_ms", "candidate_id").mapInArrow(_fold(w), "candidate_id long, cluster_id long")


def merge_events(candidates: DataFrame, signals: DataFrame, clusters: DataFrame, cfg: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(events, signals of events). events: cluster_id, KEY, candidate_id (the best member), event_type, trigger_ms, start_ms, end_ms, score, status, context, sources (the best one,
    then the others in order), merge_reason (null where nothing was merged).

    A goal's window is that of the best reason for a start, and of a hard end or else a reaction; other events have the union of windows; all at most
    so long. Contexts are put one after the other, what is said already left out, up to 6000 characters.
    """
    edge = signals.groupBy("candidate_id").agg(
        F.coalesce(F.max(F.when(F.col("signal_type") == "EVENT_BOUNDARY", F.greatest(F.lit(0), *(F.when(F.col("evidence").contains(r), q) for r, q in START_QUALITY.items())))), F.lit(0)).alias("quality"),
        F.coalesce(F.bool_or((F.col("signal_type") == "EVENT_AFTERGLOW") & F.col("evidence").rlike("END=IMMEDIATE_RESTART|END=REPLAY_BOUNDARY")), F.lit(False)).alias("hard"),
        F.coalesce(F.bool_or((F.col("signal_type") == "EVENT_AFTERGLOW") & F.col("evidence").contains("END=GOAL_REACTION")), F.lit(False)).alias("reacted"),
    )
    rows = candidates.join(clusters, "candidate_id").join(edge, "candidate_id", "left").fillna({"quality": 0, "hard": False, "reacted": False})
    live = F.coalesce(F.col("status") == "DETECTED", F.lit(False))
    whole = F.struct("candidate_id", "event_type", "trigger_ms", "score", "status", "start_ms", "end_ms", "context", "reacted")
    best = F.struct(live.cast("int"), F.col("score"), -F.col("trigger_ms"), -F.col("candidate_id"))
    of_live = lambda value, test=F.lit(True): F.when(live & test, value)
    one = rows.groupBy("cluster_id", *KEY).agg(
        F.max_by(whole, best).alias("b"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(live, 1)).alias("n_live"),
        F.min(of_live(F.col("start_ms"))).alias("from_ms"),
        F.max(of_live(F.col("end_ms"))).alias("to_ms"),
        (F.max(of_live(F.col("trigger_ms"))) - F.min(of_live(F.col("trigger_ms")))).alias("spread"),
        F.max(of_live(F.struct("quality", (-F.col("start_ms")).alias("s")))).alias("start"),
        F.min(of_live(F.col("end_ms"), F.col("hard"))).alias("hard_ms"),
        F.max_by("end_ms", of_live(F.struct("score", -F.col("trigger_ms"), -F.col("candidate_id")), F.col("reacted"))).alias("reacted_ms"),
        F.array_sort(F.collect_set("candidate_id")).alias("ids"),
    )
    goal = F.col("b.event_type") == "GOAL"
    start = F.when(goal, F.when(F.col("start.quality") > 0, -F.col("start.s")).otherwise(F.col("b.start_ms"))).otherwise(F.col("from_ms"))
    end = F.when(goal, F.coalesce("hard_ms", F.when(F.col("b.reacted"), F.col("b.end_ms")), "reacted_ms", "b.end_ms")).otherwise(F.col("to_ms"))
    merged = F.col("n") > 1
    one = one.withColumns({"start_ms": F.least(start, "b.trigger_ms"), "end_ms": F.greatest(end, "b.trigger_ms")})
    most, at = cfg.maximum_event_ms, F.col("b.trigger_ms")
    over = F.col("end_ms") - F.col("start_ms") > most
    cut = F.greatest(F.lit(0), F.least(F.col("start_ms"), at - most // 2))
    lost = over & (F.least(F.col("end_ms"), cut + most) < at)
    one = one.withColumns({
        "start_ms": F.when(lost, F.greatest(F.lit(0), at - most)).when(over, cut).otherwise(F.col("start_ms")),
        "end_ms": F.when(lost, at).when(over, F.least(F.col("end_ms"), cut + most)).otherwise(F.col("end_ms")),
    })
    for c in ("start_ms", "end_ms"):
        one = one.withColumn(c, F.when(merged, F.col(c)).otherwise(F.col(f"b.{c}")))
    reason = F.concat(F.lit("Merged "), F.col("n_live").cast("string"), F.lit(" "), F.col("b.event_type"), F.lit(" detections, "), F.col("spread").cast("string"), F.lit(" ms trigger spread"))
    replays = F.col("n") - F.col("n_live")
    reason = F.when(replays > 0, F.concat(reason, F.lit("; associated "), replays.cast("string"), F.lit(" replay-only detection(s)"))).otherwise(reason)
    said = rows.where(live & (F.trim(F.coalesce("context", F.lit(""))) != "")).groupBy("cluster_id", "context").agg(F.min(F.struct("trigger_ms", "candidate_id")).alias("o"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("o", "context"))), lambda x: x.context)
    joined = F.aggregate(pieces, F.lit(""), lambda out, x: F.when((F.char_length(out) >= 6000) | out.contains(x), out).otherwise(F.left(F.concat(F.when(out == "", out).otherwise(F.concat(out, F.lit(" | "))), x), F.lit(6000))))
    one = one.join(said.groupBy("cluster_id").agg(joined.alias("said")), "cluster_id", "left")
    sources = F.concat(F.array("b.candidate_id"), F.array_remove("ids", F.col("b.candidate_id")))
    events = settled(one.select(
        "cluster_id", *KEY, "b.candidate_id", "b.event_type", "b.trigger_ms", "start_ms", "end_ms", "b.score", "b.status",
        F.when(merged, F.col("said")).otherwise(F.col("b.context")).alias("context"), sources.alias("sources"), F.when(merged, reason).alias("merge_reason"), "spread",
    ))
    event = events.select("cluster_id", F.col("event_type").alias("e_event"), F.col("trigger_ms").alias("e_ms"), F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"), F.col("merge_reason").isNotNull().alias("merged"))
    belongs = rows.select("candidate_id", "cluster_id", live.alias("live"), F.col("trigger_ms").alias("c_ms"))
    own = signals.join(belongs, "candidate_id").join(event, "cluster_id").where(~F.col("merged") | (F.col("live") & F.col("ts_ms").between(F.col("from_ms"), F.col("to_ms"))))
    own = own.select("cluster_id", "signal_type", "event_type", "confidence", "ts_ms", "evidence").distinct()
    cue = signals.where("signal_type in ('REPLAY_CONTEXT', 'RETROSPECTIVE_CONTEXT')").groupBy("candidate_id").agg(F.max("confidence").alias("confidence"))
    told = belongs.where(~F.col("live")).join(event.where("merged"), "cluster_id").join(cue, "candidate_id", "left")
    told = told.select("cluster_id", F.lit("EVENT_ASSOCIATION").alias("signal_type"), F.col("e_event").alias("event_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("e_ms").alias("ts_ms"), F.concat(F.lit("REPLAY_OF_EXISTING_GOAL; DUPLICATE_EVENT; "), F.col("candidate_id").cast("string"), F.lit(" at "), F.col("c_ms").cast("string"), F.lit(" ms")).alias("evidence"))
    why = events.where("merge_reason is not null").select("cluster_id", F.lit("EVENT_MERGE").alias("signal_type"), "event_type", F.lit(1.0).alias("confidence"), F.col("trigger_ms").alias("ts_ms"), F.col("merge_reason").alias("evidence"))
    return events.drop("spread"), own.unionByName(told).unionByName(why)
