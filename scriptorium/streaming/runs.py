"""Runs that wait for a stream of changes to be quiet: debounced, one at a time, each once, also after a restart.

State is kept by key: the bursts of changes still open, and until when the key's last run is busy. A timer at the end of
each burst fires when the watermark passes it; a later change moves the end on, as the timer then finds no burst that
ends there. State and timers lie in the checkpoint folder with the offsets, so a query that is started again goes on where
it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptorium.sources import sinks
from scriptorium.storage import children, discard, exists, remove, saved

RUNS = "source string, first_at timestamp, run_at timestamp, changes long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(bursts: list[tuple[int, int, int]], times: list[int], quiet: int) -> list[tuple[int, int, int]]:
    """Bursts (first, last, changes) with the changes at `times`: those no farther than `quiet` from each other are one."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted([*bursts, *((t, t, 1) for t in times)]):
        if out and first <= out[-1][1] + quiet:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class Debounce(StatefulProcessor):
    """Bursts of changes by key; all times are whole microseconds."""

    def __init__(self, quiet: int, busy: int):
        self.quiet, self.busy = quiet, busy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bursts = handle.getListState("bursts", "first long, last long, n long")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [tuple(b) for b in self.bursts.get()]
        times = [t for part in rows for t in part["at"].tolist()]
        bursts = merged(known, times, self.quiet)
        self.bursts.put(bursts)
        ends = {last for _, last, _ in known}
        for _, last, _ in bursts:
            if last not in ends:
                self.handle.registerTimer(self.timer(last))
        return iter(())

    def timer(self, last: int) -> int:
        return -(-(last + self.quiet) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        known = sorted(tuple(b) for b in self.bursts.get())
        due = [b for b in known if self.timer(b[1]) <= now]
        if due:
            left = [b for b in known if b not in due]
            self.bursts.put(left) if left else self.bursts.clear()
            until = self.until.get()[0] if self.until.exists() else None
            runs = []
            for first, last, n in due:
                at = last + self.quiet
                if until is None or at >= until:  # a run that would start beside another is skipped
                    runs.append((key[0], first, at, n))
                    until = at + self.busy
            self.until.update((until,))
            if runs:
                out = pd.DataFrame(runs, columns=["source", "first_at", "run_at", "changes"])
                yield out.assign(first_at=pd.to_datetime(out["first_at"], unit="us", utc=True), run_at=pd.to_datetime(out["run_at"], unit="us", utc=True))

    def close(self) -> None:
        pass


def debounced_stream(changes: DataFrame, quiet: str = "5 seconds", late: str = "1 minute", busy: str = "0 seconds") -> DataFrame:
    """(source, first_at, run_at, changes) of a stream (source, ts): a run for changes that follow each other within
    `quiet`, that long after the last. A run takes `busy`; one of the same source that would start meanwhile is skipped.
    Changes that come more than `late` behind the newest are dropped."""
    us = lambda text: int(pd.Timedelta(text) / pd.Timedelta("1us"))
    rows = changes.filter("source IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).select("source", "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("source").transformWithStateInPandas(Debounce(us(quiet), us(busy)), RUNS, "Append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers need; the session's own setting comes back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def run_each(runs: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Calls act(runs of a batch, number of the batch) for every batch with runs, until no change is left to read.

    A batch that was cut off is given again under the same number, so act has to replace what that number wrote. Its
    rows are written once first: state must not be computed twice in a batch.
    """

    def batch(rows: DataFrame, number: int) -> None:
        kept = saved(rows, "runs")
        if kept.take(1):
            act(kept, number)
        discard(kept)

    with keyed_state(runs.sparkSession):
        query = runs.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()


def write_runs(runs: DataFrame, path: str, checkpoint: str) -> None:
    """Each batch's runs in a folder of its number."""
    run_each(runs, lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}"), checkpoint)


def sync_bibtex(changes: DataFrame, library: Callable[[], DataFrame], path: str, checkpoint: str, quiet: str = "3 seconds", late: str = "1 minute") -> None:
    """Exports the library after each quiet time of its changes, as it is then: one export a batch, of which the newest counts.

    A new export is written whole beside the last one, which goes only afterwards. An empty library is not exported.
    """
    spark = changes.sparkSession

    def export(rows: DataFrame, number: int) -> None:
        papers = library()
        if not papers.take(1):
            return
        target = f"{path}/batch={number}"
        remove(spark, target)  # of a batch that was cut off
        sinks.export_bibtex(papers, target, escape=True)
        for name in children(spark, path):
            if name.startswith("batch=") and int(name[6:]) < number:
                remove(spark, f"{path}/{name}")

    run_each(debounced_stream(changes, quiet, late), export, checkpoint)


def synced_path(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest whole export; None before the first."""
    numbers = sorted((int(name[6:]) for name in children(spark, path) if name.startswith("batch=")), reverse=True)
    return next((f"{path}/batch={n}" for n in numbers if exists(spark, f"{path}/batch={n}/_SUCCESS")), None)
