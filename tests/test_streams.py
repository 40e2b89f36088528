"""Streams that keep state, stopped in the middle and started again on the same checkpoint."""

import datetime as dt
import random

import pytest

from scriptorium.operators import records
from scriptorium.streaming import runs

T0 = dt.datetime(2024, 5, 1, 12, 0)
CHANGES = "source string, ts timestamp"


def files(spark, folder, parts):
    """Writes each part as one file, in order of their names."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(f"{folder}/part={i}")


def stream(spark, folder):
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/")


def bursts(rng, source, n):
    rows, at = [], T0
    for _ in range(n):
        at += dt.timedelta(seconds=rng.choice((0.5, 1, 4, 5, 6, 30)))
        rows.append((source, at))
    return rows


def plain(rows, quiet=5, busy=0):
    out = []
    for source in {s for s, _ in rows}:
        times, own = sorted(t for s, t in rows if s == source), []
        for t in times:
            if own and t <= own[-1][1] + dt.timedelta(seconds=quiet):
                own[-1][1:] = [t, own[-1][2] + 1]
            else:
                own.append([t, t, 1])
        until = None
        for first, last, n in own:
            at = last + dt.timedelta(seconds=quiet)
            if until is None or at >= until:
                out.append((source, first, at, n))
                until = at + dt.timedelta(seconds=busy)
    return sorted(out)


@pytest.mark.parametrize("busy", [0, 20])
def test_debounced_runs_over_a_restart(spark, tmp_path, busy):
    rng = random.Random(busy)
    rows = sorted(bursts(rng, "a", 40) + bursts(rng, "b", 25), key=lambda r: r[1])
    # neighbours change places: late by less than the watermark allows
    rows = [r for i in range(0, len(rows), 2) for r in reversed(rows[i : i + 2])]
    end = [("z", T0 + dt.timedelta(days=1))]  # moves the watermark past all runs
    how = {"quiet": "5 seconds", "late": "40 seconds", "busy": f"{busy} seconds"}
    half = len(rows) // 2
    files(spark, f"{tmp_path}/in", [rows[:10], rows[10:half]])
    go = lambda: runs.write_runs(runs.debounced_stream(stream(spark, f"{tmp_path}/in"), **how), f"{tmp_path}/out", f"{tmp_path}/state")
    go()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    files(spark, f"{tmp_path}/in/more", [rows[half:], end])
    go()  # a new query on the same checkpoint; bursts that were open go on
    got = sorted((r.source, r.first_at, r.run_at, r.changes) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert 0 < first < len(got)
    assert got == plain(rows, busy=busy)
    go()  # nothing new
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got)
    if not busy:
        batch = records.debounced(spark.createDataFrame(rows, CHANGES), "5 seconds").collect()
        assert got == sorted((r.source, r.first_at, r.run_at, r.changes) for r in batch)


def test_a_batch_that_was_cut_off_is_replaced(spark, tmp_path):
    files(spark, f"{tmp_path}/in", [[("a", T0), ("a", T0 + dt.timedelta(minutes=9))], [("z", T0 + dt.timedelta(days=1))]])
    calls = []

    def act(rows, number):
        calls.append(number)
        rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        if len(calls) == 2:
            raise ValueError("the machine is gone")

    make = lambda: runs.debounced_stream(stream(spark, f"{tmp_path}/in"), late="10 seconds")
    with pytest.raises(Exception, match="gone"):
        runs.run_each(make(), act, f"{tmp_path}/state")
    runs.run_each(make(), act, f"{tmp_path}/state")
    assert calls[1] == calls[2]
    assert sorted(r.run_at for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [T0 + dt.timedelta(seconds=5), T0 + dt.timedelta(minutes=9, seconds=5)]


def test_bibtex_follows_the_library(spark, tmp_path):
    library = [("One", 2020)]
    titles = lambda: spark.createDataFrame([(["Ana Cole"], y, t, "V", "10.1/1") for t, y in library], "names array<string>, year int, title string, venue string, doi string")
    sync = lambda: runs.sync_bibtex(stream(spark, f"{tmp_path}/in"), titles, f"{tmp_path}/bib", f"{tmp_path}/state", late="1 second")
    read = lambda: "\n".join(r.value for r in spark.read.text(runs.synced_path(spark, f"{tmp_path}/bib")).collect())
    assert runs.synced_path(spark, f"{tmp_path}/bib") is None
    files(spark, f"{tmp_path}/in", [[("library", T0)], [("library", T0 + dt.timedelta(minutes=1))]])
    sync()
    assert "One" in read()
    before = runs.synced_path(spark, f"{tmp_path}/bib")
    library.append(("Two & more", 2021))
    files(spark, f"{tmp_path}/in/more", [[("library", T0 + dt.timedelta(minutes=2))], [("library", T0 + dt.timedelta(minutes=3))]])
    sync()
    assert "One" in read() and r"Two \& more" in read()
    assert runs.synced_path(spark, f"{tmp_path}/bib") != before and len(runs.children(spark, f"{tmp_path}/bib")) == 1


def test_merged_bursts():
    assert runs.merged([(0, 4, 2)], [20, 9, 8, 30], 5) == [(0, 9, 4), (20, 20, 1), (30, 30, 1)]
    assert runs.merged([], [0, 5, 11], 5) == [(0, 5, 2), (11, 11, 1)]
