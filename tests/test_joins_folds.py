"""The operators against plain loops: nulls, ties, fractional bounds, clashing names, empty tables, many chunks."""

import random

import __spark_entry__  # noqa: F401  registers the queries
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import books, folds, joins
from tidemill.registry import QUERIES

from oracle import SF


def made(rng, n, keys="ab"):
    return [(i, rng.choice([*keys, None]), rng.choice([None, *range(40)]), rng.choice([1.5, 2.5, None])) for i in range(n)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("width,lag,equal", [(None, 0, True), (7, 0, True), (5, 3, True), (6, 0, False)])
def test_asof(spark, direction, width, lag, equal):
    rng = random.Random(1)
    left, right = made(rng, 60), made(rng, 50)
    schema = "id long, k string, t long, v double"
    got = joins.asof_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "t", ["k"], ["v", "id"], direction, lag, equal, width).collect()
    want = []
    for i, k, t, v in left:
        best = None
        for j, k2, t2, v2 in right:
            if None in (k, t, t2) or k != k2:
                continue
            gap = t - lag - t2 if direction == "backward" else t2 - t - lag
            if gap > 0 or gap == 0 and equal:
                key = (-gap, (v2 is not None, v2 or 0, j)) if direction == "backward" else (-gap, tuple(-x for x in (v2 is not None, v2 or 0, j)))
                if best is None or key > best[0]:
                    best = (key, v2, j)
        want.append((i, k, t, v, *(best[1:] if best else (None, None))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_asof_of_empty_tables(spark):
    schema = "id long, k string, t long, v double"
    none, some = spark.createDataFrame([], schema), spark.createDataFrame([(1, "a", 2, 3.0)], schema)
    assert [r.asof_v for r in joins.asof_join(some, none, "t", ["k"], ["v"], width=5).collect()] == [None]
    assert joins.asof_join(none, some, "t", ["k"], ["v"]).count() == 0


@pytest.mark.parametrize("width", [1, 3.7, 10])
def test_ranges(spark, width):
    rng = random.Random(3)
    points = [(i, rng.choice(["a", "b", None]), rng.choice([None, round(rng.uniform(-50, 400), 1)]), "p") for i in range(150)] + [(900, "a", 10.2, "p")]
    ranges = [(i, rng.choice(["a", "b", None]), s, rng.choice([None, s + rng.choice([0, -3, 0.5, 5, 5000]), round(s + rng.uniform(0, 60), 1)]), "r") for i in range(60) for s in [round(rng.uniform(-60, 380), 1)]] + [(900, "a", 5.0, 10.5, "r")]
    got = joins.range_join(spark.createDataFrame(points, "id long, k string, x double, note string"), spark.createDataFrame(ranges, "id long, k string, s double, e double, note string"), "x", "s", "e", ["k"], width)
    want = sorted((p[0], r[0]) for p in points for r in ranges if p[1] is not None and p[1] == r[1] and None not in (p[2], r[3]) and r[2] <= p[2] < r[3])
    assert sorted((r["id"], r["id_range"]) for r in got.collect()) == want and (900, 900) in want
    assert set(got.columns) == {"id", "k", "x", "note", "id_range", "s", "e", "note_range"}


def test_running(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), t, i, rng.choice([None, 1, -2, 5])) for i, t in enumerate(rng.choices(range(60), k=200))]
    got = folds.running(spark.createDataFrame(rows, "k string, t long, i long, v long"), ["k"], F.floor(F.col("t") / 7), ["t", "i"], {"s": F.coalesce("v", F.lit(0))}, {"m": F.col("v")}).collect()
    state, want = {}, []
    for k, t, i, v in sorted(rows, key=lambda r: r[:3]):
        s, m = state.get(k, (0, None))
        state[k] = s, m = s + (v or 0), v if m is None else m if v is None else max(m, v)
        want.append((k, t, i, v, s, m))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_admission_and_equity(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("pq"), i, t, t + rng.choice([0, 0, 3]), t + rng.choice([3, 5, 40, 3]), rng.choice([0.5, -1.0, 2.0])) for i in range(250) for t in [rng.randrange([600, 4000, 100, 20000][seed])]]
    rows += [("p", 900, None, 1, 2, 1.0), (None, 901, 1, 1, 2, 1.0)]
    frame = spark.createDataFrame(rows, "book string, id long, signal long, entry long, leave long, r double")
    cap, gap = [(2, 4), (1, 0), (3, 0), (0, 5)][seed]
    want = {}
    for book in "pq":
        held, last = [], None
        for _, i, t, _, end, _ in sorted((r for r in rows if r[0] == book and r[2] is not None), key=lambda r: (r[2], r[1])):
            held = [e for e in held if e >= t]
            want[i] = len(held) < cap and (last is None or t - last >= gap)
            if want[i]:
                held.append(end)
                last = t
    assert {r.id: r.admitted for r in books.admit(frame, "book", "signal", "leave", cap, gap, 50).collect()} == want
    risk, after = 0.3, {}
    for book in "pq":
        value, stake = 1.0, {}
        mine = [r for r in rows if r[0] == book]
        for t, opens, _, _, r in sorted([(r[3], 1, 0, r[1], r) for r in mine] + [(r[4], 0, r[3], r[1], r) for r in mine]):
            if opens:
                stake[r[1]] = value * risk
            else:
                value += stake.get(r[1], value * risk) * r[5]
                after[r[1]] = value
    got = {r.id: r.equity_after for r in books.equity(frame, "book", "entry", "leave", "r", risk, 50).collect()}
    assert got.keys() == after.keys() and all(abs(got[k] - v) <= 1e-9 * max(1, abs(v)) for k, v in after.items())


def test_volatility(spark):
    rng = np.random.default_rng(0)
    frames = [pd.DataFrame({"k": k, "t": np.cumsum(rng.integers(1, 4, n)), "p": np.exp(np.cumsum(rng.normal(size=n) * 0.1))}) for k, n in (("a", 900), ("b", 3), ("c", 1))]
    for width in (1, 10, 300, 10**6):
        got = folds.ewm_volatility(spark.createDataFrame(pd.concat(frames)), "k", "t", "p", 20, width).toPandas().sort_values(["k", "t"])
        want = []
        for f in frames:
            r = np.log(f.p).diff().fillna(0)
            want.append(np.maximum(np.sqrt((r**2).ewm(span=20, adjust=False, min_periods=20).mean()), 1e-6).where(np.arange(len(f)) >= 19))
        assert np.allclose(got.sigma.to_numpy(float), np.concatenate(want), rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("cap,gap,chunk", [(1, 0, 30), (3, 7, 30)])
def test_a_book_that_is_never_empty(spark, cap, gap, chunk):
    """Trades that stay open over several chunks, at all times some of them."""
    rng = random.Random(cap)
    rows = [("p", i, 2 * i, 2 * i + 1, 2 * i + rng.choice([30, 90, 200]), rng.uniform(-1, 1)) for i in range(300)] + [("q", i, 3 * i, 3 * i, 3 * i + 1, 0.5) for i in range(20)]
    frame = spark.createDataFrame(rows, "book string, id long, signal long, entry long, leave long, r double")
    want, held, last = {}, [], None
    for _, i, t, _, end, _ in rows[:300]:
        held = [e for e in held if e >= t]
        want[i] = len(held) < cap and (last is None or t - last >= gap)
        if want[i]:
            held.append(end)
            last = t
    got = books.admit(frame.where("book = 'p'"), "book", "signal", "leave", cap, gap, chunk).collect()
    assert {r.id: r.admitted for r in got} == want
    value, stake, after = 1.0, {}, {}
    for _, opens, i, r in sorted([(r[3], 1, r[1], r[5]) for r in rows[:300]] + [(r[4], 0, r[1], r[5]) for r in rows[:300]], key=lambda e: (e[0], e[1])):
        if opens:
            stake[i] = value
        else:
            value += 0.02 * r * stake[i]
            after[i] = value, stake[i]
    found = books.equity(frame, "book", "entry", "leave", "r", 0.02, chunk, 1.0).where("book = 'p'").collect()
    # exits of one time are in order of entry, so only values after the last of them are the loop's
    last_of = {r[4]: r[1] for r in rows[:300]}
    assert all(abs(r.base - after[r.id][1]) < 1e-9 for r in found) and len(found) == 300
    assert all(abs(r.equity_after - after[r.id][0]) < 1e-9 for r in found if r.id in last_of.values())


@pytest.mark.parametrize("width", [1, 6, 1000])
def test_asof_of_sources(spark, width):
    """Ties, nulls, repeated rows and fractional lags; the main rows are shuffled once."""
    rng = random.Random(width)
    left, one, two, none = made(rng, 60), made(rng, 50), made(rng, 40), []
    schema = "id long, k string, t long, v double"
    frames = [spark.createDataFrame(x, schema) for x in (left, one, two, none)]
    sources = {"one": (frames[1], "t", ["v", "id"], 0), "two": (frames[2], "t", ["id"], 2.5), "none": (frames[3], "t", ["v"], 1)}
    got = joins.asof_sources(frames[0], sources, "t", ["k"], width)

    def last(row, rows, lag, key):
        fits = [(t2 + lag, key(v2, j)) for j, k2, t2, v2 in rows if None not in (row[1], row[2], t2) and k2 == row[1] and t2 + lag <= row[2]]
        return max(fits, key=lambda f: (f[0], tuple((x is not None, x or 0) for x in f[1])))[1] if fits else None

    want = [(*r, *(last(r, one, 0, lambda v, j: (v, j)) or (None, None)), *(last(r, two, 2.5, lambda v, j: (j,)) or (None,)), None) for r in left]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_bars_to_fill_on(spark):
    """Five fine bars or the coarse one; nothing beyond a hole, or where the first bar is missing; repeated and null rows."""
    from tidemill.sources.candles import fill_bars

    bar = lambda k, t: (k, t, 1.0, 2.0, 0.5, 1.5)
    five = [bar("a", t) for t in (0, 300, 600, 1200)] + [bar("a", 300), bar("b", 300), bar(None, 0), ("a", None, 1.0, 1.0, 1.0, 1.0)]
    one = [bar("a", t) for t in range(300, 600, 60)] + [bar("a", 300)] + [bar("a", t) for t in (0, 60, 120, 180, 660, 1200, 1260, 1320, 1380, 1440)] + [bar("b", t) for t in range(300, 600, 60)]
    schema = "k string, t long, open double, high double, low double, close double"
    frames = spark.createDataFrame(five, schema), spark.createDataFrame(one, schema)
    fine = [(t, t + 60) for t in range(300, 600, 60)]
    found = lambda start: sorted((r.k, r.t, r.end) for r in fill_bars(*frames, "k", 300, 60, start).collect())
    assert found(None) == sorted([("a", 0, 300), *(("a", *f) for f in fine), ("a", 600, 900), *(("b", *f) for f in fine)])
    assert found(0) == sorted([("a", 0, 300), *(("a", *f) for f in fine), ("a", 600, 900)])
    assert found(1200) == [("a", t, t + 60) for t in range(1200, 1500, 60)]


def test_forward_values_of_any_delay(spark):
    """A row whose next view comes after more than six hours has its value too."""
    found = QUERIES["d08_asof_forward"](spark, SF).where("asof_value IS NOT NULL").count()
    views, clicks = (f"SELECT user_id, floor(epoch(ts)) AS t FROM read_parquet('{SF}/events.parquet') WHERE event_type = '{kind}'" for kind in ("view", "click"))
    assert found == duckdb.sql(f"SELECT count(*) FROM ({clicks}) AS c WHERE EXISTS (SELECT 1 FROM ({views}) AS v WHERE v.user_id = c.user_id AND v.t >= c.t)").fetchall()[0][0]


def test_signals_of_one_time_are_one_row_of_a_task(spark, monkeypatch):
    """Forty trades at each of thirty times: what a book's tasks go through is thirty rows, and the flags are a loop's."""
    rng, taken, settled = random.Random(5), {}, books.settled

    def counted(rows, name):
        out = settled(rows, name)
        taken.setdefault(name, out.count())
        return out

    monkeypatch.setattr(books, "settled", counted)
    rows = [("p", i, 7 * (i % 30), 7 * (i % 30) + rng.choice([0, 9, 40, 130])) for i in range(1200)]
    frame = spark.createDataFrame(rows, "book string, id long, signal long, leave long")
    want, held, last = {}, [], None
    for _, i, t, end in sorted(rows, key=lambda r: (r[2], r[1])):
        held = [e for e in held if e >= t]
        want[i] = len(held) < 3 and (last is None or t - last >= 5)
        if want[i]:
            held.append(end)
            last = t
    found = books.admit(frame, "book", "signal", "leave", 3, 5, 50).collect()
    assert len(found) == 1200 and {r.id: r.admitted for r in found} == want and 0 < sum(want.values()) < 30
    assert taken["signals"] == 30
