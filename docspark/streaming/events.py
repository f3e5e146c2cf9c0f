"""File events as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def coalesce_events_stream(events: DataFrame, watermark: str = "10 seconds", gap: str = "1.999999 seconds") -> DataFrame:
    """The streaming twin of ``coalesce_events``: session windows on a root, one row per path of a session.

    A session merges events exactly one gap apart where the batch form splits at two seconds, hence the
    shorter gap. Events later than the watermark are dropped.
    """
    e = F.sort_array(F.collect_list(F.struct("ts", "event_id", "path", "event_type")))
    g = events.withWatermark("ts", watermark).groupBy("root_id", F.session_window("ts", gap).alias("w")).agg(e.alias("e"))
    g = g.select("root_id", F.col("w.start").alias("burst_start"), "e", F.explode(F.array_distinct(F.transform("e", lambda x: x["path"]))).alias("path"))
    own = F.filter("e", lambda x: x["path"] == F.col("path"))
    types = F.transform(own, lambda x: x["event_type"])
    others = F.filter(types, lambda t: t != "modified")
    last = F.element_at(types, -1)
    kind = (
        F.when(F.array_contains(types, "removed"), "removed")
        .when(F.array_contains(types, "renamed"), "renamed")
        .when((last == "modified") & (F.size(others) > 0) & (F.try_element_at(others, F.lit(-1)) == "created"), "created")
        .otherwise(last)
    )
    return g.select("root_id", "burst_start", "path", kind.alias("event_type"), F.element_at(own, -1)["ts"].alias("last_ts"))


STATE = "low long, high long, path string, removed boolean, renamed boolean, last_us long, last_id long, last_type string, other_us long, other_id long, other_type string"


class _Bursts(StatefulProcessor):
    """Open bursts of a root, each path of a burst folded to one row: what it takes hangs on the paths, not on the events."""

    def __init__(self, gap_us: int) -> None:
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("bursts", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the interface)
        bursts = self._bursts()
        for pdf in rows:
            for us, event_id, path, kind in zip(pdf["us"].tolist(), pdf["event_id"].tolist(), pdf["path"], pdf["event_type"], strict=True):
                joined = [b for b in bursts if us - b["high"] < self.gap and b["low"] - us < self.gap]
                bursts = [b for b in bursts if b not in joined]
                whole = {"low": us, "high": us, "paths": {}}
                for b in joined:  # an event may close the gap between two bursts
                    whole["low"], whole["high"] = min(whole["low"], b["low"]), max(whole["high"], b["high"])
                    for p, state in b["paths"].items():
                        whole["paths"][p] = _folded(whole["paths"].get(p), state)
                other = (us, event_id, kind) if kind != "modified" else None
                whole["paths"][path] = _folded(whole["paths"].get(path), (kind == "removed", kind == "renamed", (us, event_id, kind), other))
                bursts.append(whole)
        self._keep(bursts)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        bursts = self._bursts()
        out = [(key[0], b["low"], p, _kind(s), s[2][0]) for b in bursts if b["high"] + self.gap <= now for p, s in b["paths"].items()]
        self._keep([b for b in bursts if b["high"] + self.gap > now])
        if out:
            yield pd.DataFrame(out, columns=["root_id", "start_us", "path", "event_type", "last_us"])

    def _bursts(self) -> list[dict]:
        found: dict = {}
        for low, high, path, removed, renamed, *rest in self.open.get() if self.open.exists() else ():
            last, other = tuple(rest[:3]), tuple(rest[3:]) if rest[5] is not None else None
            found.setdefault((low, high), {"low": low, "high": high, "paths": {}})["paths"][path] = removed, renamed, last, other
        return list(found.values())

    def _keep(self, bursts: list[dict]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        rows = [(b["low"], b["high"], p, removed, renamed, *last, *(other or (None, None, None))) for b in bursts for p, (removed, renamed, last, other) in b["paths"].items()]
        if rows:
            self.open.put(rows)
        else:
            self.open.clear()
        for b in bursts:
            self.handle.registerTimer(-(-(b["high"] + self.gap) // 1000))

    def close(self) -> None:
        pass


def _folded(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    return a[0] or b[0], a[1] or b[1], max(a[2], b[2]), max(filter(None, (a[3], b[3])), default=None)


def _kind(state: tuple) -> str:
    removed, renamed, last, other = state
    return "removed" if removed else "renamed" if renamed else "created" if last[2] == "modified" and other and other[2] == "created" else last[2]


def coalesce_events_folded(events: DataFrame, watermark: str = "10 seconds", gap_seconds: float = 2.0) -> DataFrame:
    """``coalesce_events_stream`` with keyed state: a root's state has one row for each path of an open burst, whatever the number of events.

    Events may come in any order within the watermark; a burst is given out once the watermark is ``gap_seconds`` past its last event,
    and later events are dropped. State lies in RocksDB, which the session must name as its state store.
    """
    rows = events.withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts"))
    out = rows.groupBy("root_id").transformWithStateInPandas(
        _Bursts(int(gap_seconds * 1_000_000)), f"root_id {dict(events.dtypes)['root_id']}, start_us long, path string, event_type string, last_us long", "Append", "EventTime"
    )
    return out.select("root_id", F.timestamp_micros("start_us").alias("burst_start"), "path", "event_type", F.timestamp_micros("last_us").alias("last_ts"))
