"""Training runs watched while they write their logs: a few numbers of state for each run, and a timer that drops them.

Works on a stream and, through the same processor, on a finished table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pairloom.functions.symbols import kv_array, kv_scalar
from pairloom.sources.logs import dead_units

#: What a stream of this kind keeps its state in.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "run string, iter long, event string, value double"
_STATE = "first double, last double, best double, best_iter long, last_iter long, seen long, flat boolean, dead boolean, grown boolean"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


class _Watch(StatefulProcessor):
    def __init__(self, patience: int, least: float, dead: int, ratio: float, idle_ms: int):
        self.patience, self.least, self.dead, self.ratio, self.idle_ms = patience, least, dead, ratio, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _STATE)

    def _step(self, s: dict, r, out: list) -> None:
        """One checkpoint; those that are not after the last one seen only count."""
        s["seen"] += 1
        if r.iter <= s["last_iter"]:
            return
        s["last_iter"] = int(r.iter)
        if pd.notna(r.value):
            x = float(r.value)
            s["first"] = x if s["first"] is None else s["first"]
            s["last"] = x
            if s["best"] is None or x > s["best"] + self.least:
                s["best"], s["best_iter"], s["flat"] = x, int(r.iter), False
            elif r.iter - s["best_iter"] >= self.patience and not s["flat"]:
                s["flat"] = True
                out.append((int(r.iter), "plateau", s["best"]))
            if not s["grown"] and s["first"] and abs(x / s["first"]) >= self.ratio:
                s["grown"] = True
                out.append((int(r.iter), "drift", x / s["first"]))
        if pd.notna(r.low):
            many = r.low >= self.dead
            if many and not s["dead"]:
                out.append((int(r.iter), "dead units", float(r.low)))
            s["dead"] = bool(many)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = dict(zip(_NAMES, self.run.get())) if self.run.exists() else dict.fromkeys(_NAMES) | {"last_iter": -1, "seen": 0, "best_iter": 0, "flat": False, "dead": False, "grown": False}
        out: list = []
        for r in pd.concat(list(rows)).sort_values("iter").itertuples():
            self._step(s, r, out)
        self.run.update(tuple(s[n] for n in _NAMES))
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t if isinstance(t, int) else t[0])
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._given(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = dict(zip(_NAMES, self.run.get())) if self.run.exists() else None
        self.run.clear()
        yield self._given(key, [(s["last_iter"], "silent", s["last"])] if s else [])

    def _given(self, key, out: list) -> pd.DataFrame:
        made = {"run": [key[0]] * len(out), "iter": [int(o[0]) for o in out], "event": [o[1] for o in out], "value": [o[2] for o in out]}
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in made.items()})

    def close(self) -> None:
        pass


def watch(lines: DataFrame, key: str, patience: int = 1000, least: float = 0.0, dead: int = 1, ratio: float = 10.0, idle_seconds: int = 0) -> DataFrame:
    """(run, iter, event, value) of lines (run, line) as they arrive; of a batch's lines of one run, those of a lower iter first.

    plateau: key=value has not risen by more than `least` for `patience` iterations (value: the best); again after each rise. dead units: at
    least `dead` of data_rate are almost always off or on (value: how many), once until there are fewer. drift: the value has become
    `ratio` times the first (value: the ratio), once. silent: no line for idle_seconds (value: the last), and the run's state
    is dropped. A checkpoint that is not after the last one seen changes nothing. Lines without iter are left out.
    """
    at = kv_scalar(F.col("line"), "iter").cast("long")
    rates = kv_array(F.col("line"), "data_rate")
    low = F.when(F.size(rates) > 0, dead_units(rates)).cast("long")
    parsed = lines.filter("run IS NOT NULL").select("run", at.alias("iter"), kv_scalar(F.col("line"), key).alias("value"), low.alias("low")).filter("iter IS NOT NULL")
    _ = lines.sparkSession.streams.active  # starts the keeper of state, which a table's plan needs as well
    mode = "processingTime" if idle_seconds and lines.isStreaming else "none"
    watcher = _Watch(patience, least, dead, ratio, idle_seconds * 1000 if mode != "none" else 0)
    return parsed.groupBy("run").transformWithStateInPandas(watcher, EVENTS, "Append", mode)
