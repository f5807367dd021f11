"""Runs watched by a stateful stream: the same events as over the finished table, also across a restart."""

from __future__ import annotations

from pairloom.storage import setting
from pairloom.streaming import runs

KEY = "spark.sql.streaming.stateStore.providerClass"


def _lines():
    out = []
    for i in range(1, 21):
        out.append(("up", f"iter={i * 100} lpl={-2.0 + 0.05 * min(i, 6)} data_rate=[0.5, {0.01 if i >= 12 else 0.4}]"))
        out.append(("wild", f"iter={i * 100} lpl={1.0 * 2**i}"))
    return [*out, ("odd", "no checkpoint"), ("odd", "iter=5 lpl=NaN"), (None, "iter=1 lpl=1.0")]


WANT = {("up", 1100, "plateau", -1.7), ("up", 1200, "dead units", 1.0), ("wild", 500, "drift", 16.0)}


def _rows(df):
    return {(r.run, r.iter, r.event, round(r.value, 9)) for r in df.collect()}


def test_finished_logs(spark):
    with setting(spark, KEY, runs.PROVIDER):
        lines = spark.createDataFrame(_lines(), "run string, line string")
        assert _rows(runs.watch(lines, "lpl", patience=500)) == WANT


def test_stream_equals_table_across_a_restart(spark, tmp_path):
    with setting(spark, KEY, runs.PROVIDER):
        rows, kind = _lines(), "run string, line string"
        src = str(tmp_path / "in")
        for part in (rows[:13], rows[13:30], rows[30:]):
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").json(src)
            stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(src)
            q = runs.watch(stream, "lpl", patience=500).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
            q.awaitTermination(120)
            assert q.exception() is None
            kept = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
            assert kept and max(kept) <= 3  # a row for each run
        assert _rows(spark.read.parquet(str(tmp_path / "out"))) == WANT
