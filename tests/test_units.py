"""Single operators against what is known: simulated trades, bodies of the executor, ids, sources, month files, tables of batches."""

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemill.functions import futures, validation
from tidemill.operators.simulate import Rules, simulate
from tidemill.plans import accounts
from tidemill.sources.candles import fill, read_candles
from tidemill.streaming.executor import advance
from tidemill.streaming.tables import insert_new, publish, upsert

BARS = "instrument string, i long, open double, high double, low double, close double"
TRADES = "instrument string, id long, start long, side int, b double"


def expected_trade(bars, start, side, b, rules):
    """One trade from conditions on all bars it may see: which could fill it, stop it or reach its target, and the least of each."""
    if start not in bars:
        return None
    beyond = lambda x, level: side * x <= side * level  # noqa: E731  as bad for the trade as level
    adverse, favour = ({k: bar[c] for k, bar in bars.items()} for c in ((2, 1) if side > 0 else (1, 2)))
    at, price, maker, within = start, bars[start][0], False, False
    if rules.pullback is not None:
        limit, asked = price * math.exp(-side * rules.pullback * b), [k for k in range(start, start + rules.wait) if k in bars]
        opened = {k for k in asked if beyond(bars[k][0], limit)}
        traded = {k for k in asked if beyond(adverse[k], limit * (1 - side * rules.through))}
        at = min(opened | traded, default=start + rules.wait)
        maker, within = at in opened | traded, at in traded - opened
        if at not in bars:
            return None
        price = limit if within else bars[at][0]
    target, stop = (price * math.exp(sign * side * share * b) for sign, share in ((1, rules.tp), (-1, rules.sl)))
    held = [k for k in range(at, at + rules.hold) if k in bars]
    stopped = min((k for k in held if beyond(adverse[k], stop)), default=math.inf)
    reached = min((k for k in held if beyond(target, favour[k]) and not (within and k == at)), default=math.inf)
    if min(stopped, reached) == math.inf:
        return at, price, maker, held[-1], bars[held[-1]][3], "TIMEOUT" if len(held) == rules.hold else "CUT"
    if stopped <= reached:
        return at, price, maker, stopped, side * min(side * bars[stopped][0], side * stop), "SL"
    return at, price, maker, reached, target, "TP"


@pytest.mark.parametrize("rules", [Rules(), Rules(tp=1.5, sl=0.7, hold=4, pullback=0.4, wait=2, through=0.001, maker=0.0002, taker=0.0005), Rules(pullback=0.0, wait=1, hold=1)])
def test_simulated_trades(spark, rules):
    rng, price, bars = random.Random(7), 100.0, {}
    for i in range(400):
        o = price * math.exp(rng.gauss(0, 0.004) if i % 9 == 0 else 0)
        c = o * math.exp(rng.gauss(0, 0.01))
        bars[i] = (o, max(o, c) * math.exp(abs(rng.gauss(0, 0.004))), min(o, c) * math.exp(-abs(rng.gauss(0, 0.004))), c)
        price = c
    trades = [(k, rng.randrange(-3, 405), rng.choice([1, -1]), rng.uniform(0.006, 0.03)) for k in range(250)]
    frame = spark.createDataFrame([("a", i, *b) for i, b in bars.items()], BARS)
    found = simulate(frame, spark.createDataFrame([("a", *t) for t in trades] + [("a", 900, 5, 1, None), ("b", 901, 5, 1, 0.1)], TRADES), "instrument", rules).collect()
    want = {k: expected_trade(bars, *t, rules) for k, *t in trades}
    assert {r.id for r in found} == {k for k, w in want.items() if w}
    for r in found:
        at, entry, maker, out, price, kind = want[r.id]
        assert (r.entry_at, r.maker, r.exit_at, r.kind) == (at, maker, out, kind) and math.isclose(r.entry, entry) and math.isclose(r.exit, price)
    assert {w[5] for w in want.values() if w} >= ({"SL", "TP", "TIMEOUT"} if rules.hold > 1 else {"TIMEOUT"})


def test_rules_are_checked():
    for bad in ({"tp": 0}, {"hold": 0}, {"wait": 0}, {"maker": -1}, {"pullback": -0.1}):
        with pytest.raises(ValueError):
            Rules(**bad)


def test_steps_of_the_executor():
    """Long to its target; both in one bar: the stop; a gap through the stop of a short; time out after twelve bars."""
    rules = Rules(hold=12)
    long, short = {"side": 1, "b": 0.01}, {"side": -1, "b": 0.01}
    assert advance(long, (0, 100.0, 100.5, 99.5, 100.2), rules) is None
    assert advance(long, (1, 100.2, 101.2, 100.1, 101.1), rules) == (100 * math.exp(0.01), "TP")
    assert advance({"side": 1, "b": 0.01}, (0, 100.0, 102.0, 98.0, 100.0), rules) == (100 * math.exp(-0.01), "SL")
    assert advance(short, (0, 100.0, 100.5, 99.5, 100.2), rules) is None
    assert advance(short, (1, 103.0, 104.0, 102.0, 103.0), rules) == (103.0, "SL")
    trade, ends = {"side": 1, "b": 0.5}, []
    for i in range(12):
        ends.append(advance(trade, (i, 100.0, 100.5, 99.5, 100.0 + i), rules))
    assert ends[:11] == [None] * 11 and ends[11] == (111.0, "TIMEOUT")


def test_ids_and_keys(spark):
    frame = accounts.window_uuids(spark, "/root/testdata/sf0.001").limit(20).collect()
    assert all(r.id == str(uuid.uuid5(accounts._SPACE, f"window:{r.event_id}")) for r in frame)
    assert accounts.config_key({"a": 1, "b": [1, 2]}) == accounts.config_key({"b": [1, 2], "a": 1}) != accounts.config_key({"a": 1, "b": [2, 1]})


def test_tiers(spark):
    rows = spark.createDataFrame([(1.0,), (50_000.0,), (50_000.01,), (7e7,), (1e9,)], "n double").select(futures.tier(F.col("n"))["rate"].alias("r")).collect()
    assert [r.r for r in rows] == [0.004, 0.004, 0.005, 0.02, 0.025]
    price = spark.range(1).select(*[futures.liquidation(F.lit(s), F.lit(100.0), F.lit(10.0), F.lit(20.0)).alias(n) for s, n in ((1, "long"), (-1, "short"))]).first()
    assert math.isclose(price.long, 980 / 9.96) and math.isclose(price.short, 1020 / 10.04)


def test_predicates_of_nulls_and_nans(spark):
    schema = "open double, high double, low double, close double, volume double, rate double, mark double"
    rows = [(1.0, 2.0, 0.5, 1.0, 0.0, 0.01, None), (1.0, 0.9, 0.5, 1.0, 1.0, 0.05, 1.0), (None, 2.0, 0.5, 1.0, 0.0, None, 1.0), (float("nan"), 2.0, 0.5, 1.0, 1.0, 0.01, -1.0), (1.0, float("inf"), 0.5, 1.0, 1.0, -0.01, 0.0)]
    found = spark.createDataFrame(rows, schema).select(validation.candle_valid().alias("c"), validation.funding_valid().alias("f")).collect()
    assert [(r.c, r.f) for r in found] == [(True, True), (False, False), (False, False), (False, False), (False, True)]


def test_candle_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Open_Time,open,high,low,close,volume,taker_buy_base_asset_volume\n0,1,2,0.5,1.5,10,4\n300000,1.5,2,1,x,1,1\n300000,1.5,2,1,1.2,1,1\n1200000,-1,2,1,1,1,1\n900000,1,1,1,1,0,0\n")
    rows = read_candles(spark, str(tmp_path / "a.csv"), "s", 300_000).orderBy("open_time_ms").collect()
    assert [(r.open_time_ms, r.close, r.taker_base, r.after_gap) for r in rows] == [(0, 1.5, 4.0, None), (300_000, 1.2, 1.0, False), (900_000, 1.0, 0.0, True)]
    (tmp_path / "b.csv").write_text("time,open,high,low\n0,1,2,0.5\n")
    with pytest.raises(ValueError, match="close, volume"):
        read_candles(spark, str(tmp_path / "b.csv"), "s", 300_000)
    have, other = spark.createDataFrame([("a", 1, 5.0)], "k string, t int, v double"), spark.createDataFrame([("a", 1, 6.0), ("a", 2, 7.0)], "k string, t int, v double")
    assert sorted(map(tuple, fill(have, other, ["k", "t"]).collect())) == [("a", 1, 5.0, "kept"), ("a", 2, 7.0, "filled")]


def test_tables_of_batches(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k int, at int, v string")
    table = frame([(1, 5, "a"), (2, 5, "b")])
    assert [tuple(r) for r in insert_new(table, frame([(2, 9, "x"), (3, 2, "y"), (3, 1, "z")]), ["k"], ["at"]).collect()] == [(3, 1, "z")]
    batch = frame([(1, 4, "old"), (2, 5, "same"), (3, 1, "new")])
    once = upsert(table, batch, ["k"], F.col("at"))
    assert sorted(map(tuple, once.collect())) == [(1, 5, "a"), (2, 5, "same"), (3, 1, "new")] == sorted(map(tuple, upsert(once, batch, ["k"], F.col("at")).collect()))
    box = spark.createDataFrame([(k, None) for k in range(5)], "id int, sent int")
    first, box = publish(box, "id", "sent", 3, F.lit(1))
    second, box = publish(box, "id", "sent", 3, F.lit(2))
    assert sorted(r.id for r in first.collect()) == [0, 1, 2] and sorted(map(tuple, box.collect())) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)]


def test_grid_equals_simulations(spark):
    """Each cell of the grid gives the trades of a simulation with its rules."""
    from tidemill.operators.grid import simulate_grid

    rng = random.Random(9)
    bars, trades = [], []
    for k in "ab":
        price = 100.0
        for i in range(120):
            first, price = price * math.exp(rng.gauss(0, 0.01)), price * math.exp(rng.gauss(0, 0.03))
            bars.append((k, i, first, max(first, price) * (1 + rng.random() * 0.02), min(first, price) * (1 - rng.random() * 0.02), price))
        trades += [(k, 200 + j, rng.randrange(-3, 124), rng.choice([1, -1]), rng.choice([0.01, 0.03, None, 0.05])) for j in range(80)]
    trades += [("a", 1, None, 1, 0.02), (None, 2, 5, 1, 0.02)]
    bars, trades = spark.createDataFrame(bars, "k string, i long, open double, high double, low double, close double"), spark.createDataFrame(trades, "k string, id long, start long, side int, b double")
    cells = [Rules(tp, sl, hold, back, wait, 0.001, 0.0002, 0.0005) for tp, sl, hold in ((1.0, 1.0, 9), (0.4, 2.0, 3), (3.0, 0.5, 20)) for back, wait in ((None, 3), (0.3, 3), (0.0, 1), (1.5, 5))]
    found = {}
    for r in simulate_grid(bars, trades, "k", cells).collect():
        found.setdefault(r.cell, []).append(tuple(round(x, 9) if isinstance(x, float) else x for x in r[1:]))
    columns = ["k", "id", "entry_at", "entry", "maker", "exit_at", "exit", "kind", "r", "r_net"]
    for n, rules in enumerate(cells):
        want = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in simulate(bars, trades, "k", rules).select(columns).collect()]
        assert sorted(found.get(n, [])) == sorted(want) and want
