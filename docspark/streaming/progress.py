"""Progress of answers from their events, as a table and as a stream, and the inbox fed by a stream of changes.

Events: ``operation_id, arrival, sequence, event_type, node_id, duration_ms, delta, status``. An event whose sequence isn't above
all that arrived before it is dropped; ``ask_started`` begins an operation anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What an event makes of its node.
NODE_STATUS = {"node_started": "running", "node_progress": "running", "node_completed": "completed", "node_failed": "failed", "node_skipped": "skipped"}
ENDS = ("node_completed", "node_failed", "node_skipped")
PROGRESS = "operation_id string, status string, steps long, active_node string, answer string, last_sequence long, nodes string, durations string"


def ask_progress(events: DataFrame) -> DataFrame:
    """One row per operation: ``status, steps, active_node, answer, last_sequence, nodes, durations``.

    ``nodes`` has ``node:status`` in the order of ids, ``durations`` ``node:milliseconds`` of nodes that have ended, with a
    known duration, and haven't started anew since.
    """
    before = F.max("sequence").over(Window.partitionBy("operation_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    e = events.withColumn("before", before).filter("before is null or sequence > before")
    start = F.max(F.when(F.col("event_type") == "ask_started", F.col("sequence"))).over(Window.partitionBy("operation_id"))
    e = e.withColumn("start", start).filter("start is null or sequence >= start")
    status = F.create_map(*[F.lit(x) for kv in NODE_STATUS.items() for x in kv])[F.col("event_type")]
    is_ = lambda *kinds: F.col("event_type").isin(*kinds)
    nodes = e.withColumn("node_status", status).filter("node_status is not null and node_id is not null").groupBy("operation_id", "node_id").agg(
        F.max_by("node_status", "sequence").alias("node_status"), F.max(F.when(is_("node_started"), F.col("sequence"))).alias("began"), F.max(F.when(is_(*ENDS), F.col("sequence"))).alias("ended"),
        F.max_by(F.when(is_(*ENDS), F.col("duration_ms")), F.when(is_("node_started", *ENDS), F.col("sequence"))).alias("took"),
    )
    per = nodes.groupBy("operation_id").agg(
        F.count_if(F.col("node_status") != "skipped").alias("steps"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "node_id", "node_status"))), ",").alias("nodes"),  # an operation has some ten nodes
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("took").isNotNull(), F.concat_ws(":", "node_id", F.col("took").cast("string"))))), ",").alias("durations"),
        F.max_by(F.struct("node_id", "began", "ended"), "began").alias("latest"),
    )
    whole = e.groupBy("operation_id").agg(
        F.max("sequence").alias("last_sequence"), F.max_by(F.when(is_("ask_completed"), F.when(F.col("status").isin("failed", "cancelled"), F.col("status")).otherwise("completed")), F.when(is_("ask_completed"), F.col("sequence"))).alias("final"),
        F.max(F.when(is_("ask_completed"), F.col("sequence"))).alias("closed"), F.max(F.when(is_("node_started"), F.col("sequence"))).alias("began"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_("answer_delta"), F.struct("sequence", F.coalesce("delta", F.lit("")).alias("delta"))))), lambda x: x["delta"]), "").alias("answer"),  # one answer
    )
    done = F.col("closed").isNotNull() & (F.col("began").isNull() | (F.col("closed") > F.col("began")))
    open_ = F.col("latest.began").isNotNull() & (F.col("latest.ended").isNull() | (F.col("latest.ended") < F.col("latest.began"))) & (F.col("closed").isNull() | (F.col("closed") < F.col("latest.began")))
    return whole.join(per, "operation_id", "left").select(
        F.col("operation_id").cast("string").alias("operation_id"), F.when(done, F.col("final")).when(F.col("began").isNotNull(), "running").otherwise("started").alias("status"), F.coalesce("steps", F.lit(0)).alias("steps"),
        F.when(open_, F.col("latest.node_id")).alias("active_node"), "answer", "last_sequence", F.coalesce("nodes", F.lit("")).alias("nodes"), F.coalesce("durations", F.lit("")).alias("durations"),
    )


class _Fold(StatefulProcessor):
    """An operation's state: a row of what is said of it, the parts of its answer, and its nodes. All of it is dropped when idle."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.whole = handle.getValueState("whole", "last long, status string, active string", ttlDurationMs=self.idle_ms)
        self.answer = handle.getListState("answer", "delta string", ttlDurationMs=self.idle_ms)
        self.nodes = handle.getMapState("nodes", "node string", "status string, took long", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the interface)
        last, status, active = self.whole.get() if self.whole.exists() else (None, "started", None)
        changed, said, anew = {}, [], False
        for e in pd.concat(list(rows)).sort_values("arrival").itertuples():
            if last is not None and e.sequence <= last:
                continue
            last, kind = int(e.sequence), e.event_type
            if kind == "ask_started":
                status, active, changed, said, anew = "started", None, {}, [], True
            if kind in NODE_STATUS and isinstance(e.node_id, str):
                before = changed.get(e.node_id) or (None if anew else self._node(e.node_id))
                took = None if kind == "node_started" else _whole(e.duration_ms) if kind in ENDS else before[1] if before else None
                changed[e.node_id] = NODE_STATUS[kind], took
            if kind == "node_started":
                status, active = "running", e.node_id
            elif kind in ENDS and active == e.node_id or kind == "ask_completed":
                active = None
            if kind == "ask_completed":
                status = e.status if e.status in ("failed", "cancelled") else "completed"
            if kind == "answer_delta" and isinstance(e.delta, str):
                said.append(e.delta)
        if anew:
            self.answer.clear()
            self.nodes.clear()
        if said:
            self.answer.appendList([(x,) for x in said])
        for node, state in changed.items():
            self.nodes.updateValue((node,), state)
        self.whole.update((last, status, active))
        nodes = {k[0]: tuple(v) for k, v in self.nodes.iterator()}
        yield pd.DataFrame([{
            "operation_id": str(key[0]), "status": status, "steps": sum(s != "skipped" for s, _ in nodes.values()), "active_node": active, "answer": "".join(x[0] for x in self.answer.get()), "last_sequence": last,
            "nodes": ",".join(sorted(f"{n}:{s}" for n, (s, _) in nodes.items())), "durations": ",".join(sorted(f"{n}:{t}" for n, (_, t) in nodes.items() if t is not None)),
        }])

    def _node(self, node: str) -> tuple | None:
        return tuple(self.nodes.getValue((node,))) if self.nodes.containsKey((node,)) else None

    def close(self) -> None:
        pass


def _whole(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


def ask_progress_stream(events: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """``ask_progress`` over a stream: a row whenever an operation's events arrive.

    State is a value, a list of the answer's parts and a map of nodes, so a batch writes what it adds and no more; each
    entry is dropped ``idle_ms`` after it was written last. State lies in RocksDB, which the session must name as its state store.
    """
    return events.groupBy("operation_id").transformWithStateInPandas(_Fold(idle_ms), PROGRESS, "Update", "ProcessingTime")


def inbox_stream(changes: DataFrame, time_col: str = "detected_at", late: str = "1 hour") -> DataFrame:
    """``changes`` (``file_id, event_type, revision_id``, a time, others) as inbox rows, one of each kind, file and revision within ``late``."""
    fresh = changes.withWatermark(time_col, late)
    return (fresh.dropDuplicatesWithinWatermark if changes.isStreaming else fresh.dropDuplicates)(["file_id", "event_type", "revision_id"]).withColumn("status", F.lit("unread"))
