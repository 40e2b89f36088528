import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import row_patterns

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, match_no int, letter string"
T0 = dt.datetime(2024, 3, 31, 0, 30)


def plain(rows):
    """Every start in turn, with a backtracking search over the rows: fits(letter, place)."""
    out = []
    for client in sorted({r[3] for r in rows if r[3] is not None}):
        own = sorted({r for r in rows if r[3] == client and r[1] is not None}, key=lambda r: (r[1], r[0]))
        cents = [None if r[5] is None or not math.isfinite(r[5]) else math.floor(100 * r[5] + 0.5) for r in own]

        def fits(letter, k, start):
            if k >= len(own) or cents[k] is None or own[k][1] - own[k - 1][1] > dt.timedelta(minutes=30):  # noqa: B023
                return False
            if letter == "P":
                return own[k][4] == "click" and cents[k] >= cents[start]  # noqa: B023
            if cents[k - 1] is None or own[k][4] in (None, "error"):  # noqa: B023
                return False
            return cents[k] < cents[k - 1] if letter == "D" else cents[k] > cents[k - 1]  # noqa: B023

        def groups(k, start):
            """Ends of (D+ U+)+ from k, longest choices first."""
            d = k
            while fits("D", d, start):  # noqa: B023
                d += 1
            for m in range(d, k, -1):
                u = m
                while fits("U", u, start):  # noqa: B023
                    u += 1
                for e in range(u, m, -1):
                    yield from groups(e, start)  # noqa: B023
                    yield e

        no = 0
        for s in range(len(own)):
            end = next(groups(s + 1, s), None) if cents[s] is not None else None
            if end is not None:
                labels = "A" + "".join("D" if cents[k] < cents[k - 1] else "U" for k in range(s + 1, end))
                if fits("P", end, s):
                    labels, end = labels + "P", end + 1
                no += 1
                out.append((client, no, own[s][0], own[end - 1][0], end - s, sum(cents[s:end]), hashlib.sha256(labels.encode()).hexdigest()))
    return sorted(out)


def got(spark, rows):
    found = row_patterns.op11_patterns(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256"]
    return sorted(tuple(r) for r in found.collect())


def made(rng, n, clients, minutes, values=40, start=0):
    rows, ts = [], T0
    for i in range(n):
        ts += dt.timedelta(minutes=rng.choice(minutes), microseconds=rng.choice((0, 0, 1)))
        kind = rng.choice(("click", "click", "view", "purchase", "error", None))
        value = rng.choice((None, math.nan, math.inf, 0.005)) if rng.random() < 0.05 else rng.randrange(values) / 100
        rows.append((start + i, ts, ts, rng.choice(clients), kind, value, '{"k": 1}', 3, "x"))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_backtracking(spark, seed):
    rng = random.Random(seed)
    rows = made(rng, 900, [*[1] * 60, *[2] * 20, *range(3, 20)], (0, 0, 0, 0, 1, 2, 29, 30, 31))
    rows += rng.sample(rows, 40)  # repeated rows
    rows += [(10**6 + i, T0, None, None, "click", 1.0, None, 0, "") for i in range(5)] + [(10**6 + 9, None, T0, 1, "click", 1.0, None, 0, "")]
    rng.shuffle(rows)
    want = plain(rows)
    assert len(want) > 25
    assert got(spark, rows) == want


def test_one_client_over_many_slices(spark):
    """All rows belong to one client; long segments run over the cuts."""
    rng = random.Random(8)
    rows = [(i, T0 + dt.timedelta(minutes=i // 3), None, 5, "click" if rng.random() < 0.99 else "error", [3.0, 1.0, 2.0, 0.5, 9.0, 4.0][i % 6] + rng.random(), "", 0, "") for i in range(600)]
    want = plain(rows)
    assert max(r[4] for r in want) > 100  # over several cuts
    assert got(spark, rows) == want
    ((client, cuts),) = row_patterns.time_cuts(row_patterns.clean_rows(spark.createDataFrame(rows, SCHEMA)))
    assert client == 5 and len(cuts) >= 10


def test_gap_is_exact_and_p_may_be_d(spark):
    at = lambda m, us=0: T0 + dt.timedelta(minutes=m, microseconds=us)
    rows = [(i, t, None, 1, k, v, None, 0, "") for i, (t, k, v) in enumerate([(at(0), "view", 1.0), (at(30), "view", 0.5), (at(60), "view", 3.0), (at(90), "click", 2.0), (at(120, 1), "view", 9.0)])]
    assert got(spark, rows) == plain(rows) == [(1, 1, 0, 3, 4, 650, hashlib.sha256(b"ADUP").hexdigest())]
    rows[3] = (3, at(90, 1), None, 1, "click", 2.0, None, 0, "")  # one microsecond late
    assert [r[4] for r in got(spark, rows)] == [3]


def test_empty_and_equal_times(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, None, None, None, None, None, None, None)]) == []
    rows = [(i, T0, None, 7, "click", [2.0, 1.0, 3.0][i % 3], None, 0, "") for i in range(60)]  # one microsecond
    assert got(spark, rows) == plain(rows)


def test_long_segment_needs_no_deep_stack(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), None, i // 6000, "view", [2.0, 1.0][i % 2] + i / 1e6, None, 0, "") for i in range(6001)]
    found = got(spark, rows)
    assert len(found) == 2999 and max(r[4] for r in found) == 5999


def test_place_is_a_bisection(spark):
    cuts = [2, 3, 5, 8, 13]
    df = spark.range(0, 16).select("id", row_patterns.place(F.array(*map(F.lit, cuts)), F.col("id")).alias("n"))
    assert {r.id: r.n for r in df.collect()} == {i: sum(c <= i for c in cuts) for i in range(16)}
