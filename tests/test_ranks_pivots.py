"""Order statistics of sliding frames and chunked turning points, against their definitions."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemill.operators import pivots
from tidemill.operators.pivots import Chunk, confirmed_pivots, entering
from tidemill.operators.ranks import GatedRanks, Ranks, _descend, continuous, gated_quantiles, rolling_quantiles


@pytest.mark.parametrize("n", [1, 2, 5, 40, 700])
def test_rank_tables(n):
    rng = np.random.default_rng(n)
    gate, value = rng.integers(0, 9, n) / 2, rng.integers(0, 30, n) * 1.5
    lo = rng.integers(0, n, 50)
    hi = np.array([rng.integers(a + 1, n + 1) for a in lo])
    k = np.array([rng.integers(0, b - a) for a, b in zip(lo, hi)])
    assert Ranks(value).kth(lo, hi, k).tolist() == [np.sort(value[a:b])[j] for a, b, j in zip(lo, hi, k)]
    least = rng.integers(-1, 10, 50) / 2
    tables, starts, ends, count = GatedRanks(gate, value).stretches(lo, hi, least)
    want = [np.sort(value[a:b][gate[a:b] >= g]) for a, b, g in zip(lo, hi, least)]
    assert count.tolist() == [len(w) for w in want]
    some = count > 0
    k = np.array([rng.integers(0, c) for c in count[some]])
    found = tables[0].sorted[_descend(tables, [s[some] for s in starts], [e[some] for e in ends], k)]
    assert found.tolist() == [w[j] for w, j in zip([w for w in want if len(w)], k)]


def made(seed=3, n=240):
    """Ties in time, gate and value, nulls, a null key and a clashing column."""
    rng = np.random.default_rng(seed)
    some = lambda x: [None if rng.random() < 0.1 else v for v in x]
    return list(zip(rng.choice(["a", "b"], n).tolist(), some(rng.integers(0, 200, n).tolist()), some((rng.integers(0, 12, n) / 4).tolist()), some((rng.integers(0, 40, n) / 2).tolist()), some((rng.integers(0, 12, n) / 4).tolist()), [1] * n))


@pytest.mark.parametrize("window", [1, 13, 60, 1000])
def test_frames(spark, window):
    rows = made()
    table = spark.createDataFrame(rows, "k string, t long, g double, v double, thr double, rank int").selectExpr("*", "g > 1 AS ok")
    text = lambda r: str([None if x is None else np.round(x, 9).tolist() if isinstance(x, list) else x for x in r])
    frame = lambda r, use: [o for o in rows if o[0] == r[0] and o[1] is not None and r[1] - window <= o[1] < r[1] and use(o)]
    quantiles = lambda x: np.quantile(x, [0.2, 0.9]).tolist()
    want_all, want_mask, want_gate = [], [], []
    for r in rows:
        if r[1] is not None:
            known = [o[3] for o in frame(r, lambda o: o[3] is not None)]
            want_all.append((*r, quantiles(known) if len(known) >= 3 else None, len(known)))
            masked = [o[3] for o in frame(r, lambda o: o[3] is not None and o[2] is not None and o[2] > 1)]
            want_mask.append((*r, quantiles(masked) if len(masked) >= 2 and len(known) >= 6 else None, len(masked)))
            both = frame(r, lambda o: o[2] is not None and o[3] is not None)
            asked = r[4] is not None and len(both) >= 4
            hits = [o[3] for o in both if asked and o[2] >= r[4]]
            want_gate.append((*r, quantiles(hits) if len(hits) >= 2 else None, len(hits)))
    drop = lambda df: sorted(map(text, map(tuple, df.drop("ok").collect())))
    assert drop(rolling_quantiles(table, ["k"], "t", "v", window, [0.2, 0.9], 3)) == sorted(map(text, want_all))
    assert drop(rolling_quantiles(table, ["k"], "t", "v", window, [0.2, 0.9], 2, least_rows=6, mask="ok")) == sorted(map(text, want_mask))
    assert drop(gated_quantiles(table, ["k"], "t", "g", "v", "thr", window, [0.2, 0.9], 4, 2)) == sorted(map(text, want_gate))


def by_definition(high, low, rev):
    """(pivot, confirmed, kind): each leg's end looked for among all later bars, by extremes over ranges."""
    n, out = len(high), []
    for i in range(1, n):
        top, bottom = max(high[: i + 1]), min(low[: i + 1])
        rise, fall = high[i] / bottom - 1, 1 - low[i] / top
        if rise >= max(rev, fall) and bottom in low[:i]:
            out = [(low.index(bottom), i, -1)]
        elif fall >= rev and top in high[:i]:
            out = [(high.index(top), i, 1)]
        if out:
            break
    while out:
        _, start, kind = out[-1]
        way, against = (high, low) if kind < 0 else ([-x for x in low], [-x for x in high])
        ends = (c for c in range(start + 1, n) if way[c] < max(way[start:c]) and against[c] <= max(way[start:c]) * (1 + kind * rev))
        c = next(ends, None)
        if c is None:
            break
        best = max(way[start:c])
        out.append((max(i for i in range(start, c) if way[i] == best), c, -kind))
    return out


def prices(rng, n):
    mid = np.exp(np.cumsum(rng.choice([-0.02, 0.0, 0.01, 0.02], n)))
    return mid * (1 + rng.choice([0, 0.01], n)), mid * (1 - rng.choice([0, 0.01, 0.05], n))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_chunks_compose(monkeypatch, size):
    """The legs that enter chunks, by their records alone, are those of one long chunk."""
    rng = np.random.default_rng(size)
    for block in (1, 64):
        monkeypatch.setattr(pivots, "BLOCK", block)
        for n in (3, 50, 300, 2500):
            (high, low), t = prices(rng, n), np.arange(n)
            for rev, kind in ((0.01, 1), (0.05, -1), (0.2, 1)):
                whole = Chunk(t, high, low, rev)
                want, _ = whole.follow(whole.fresh(kind, 0), 1)
                chunks = {k: Chunk(t[a : a + size], high[a : a + size], low[a : a + size], rev) for k, a in enumerate(range(0, n, size))}
                rows = [(0, 0, 0, 0.0, *chunks[0].leaves(kind, 0))] + [(k, s, i, v, *leg) for k, c in chunks.items() if k for s, i, v, leg in c.records()]
                found, _ = chunks[0].follow(chunks[0].fresh(kind, 0), 1)
                for k, *leg in entering(pd.DataFrame(rows, columns=["chunk", "side", "place", "value", "kind", "best", "at"]), rev):
                    found += chunks[k].follow(tuple(leg), 0)[0]
                assert found == want


def test_records_are_few():
    """A long rise is one record of highs, not one a bar."""
    up = np.linspace(1, 3, 5000)
    assert len(Chunk(np.arange(5000), up * 1.001, up, 0.05).records()) == 2


@pytest.mark.parametrize("width", [1, 9, 500])
def test_pivots(spark, width):
    rng, rows, want = np.random.default_rng(width), [], []
    for k in range(6):
        high, low = (x.tolist() for x in prices(rng, int(rng.integers(1, 130))))
        rows += [(str(k), i, h, x, "x", 0) for i, (h, x) in enumerate(zip(high, low))]
        want += [(str(k), p, c, (high if kind > 0 else low)[p], kind) for p, c, kind in by_definition(high, low, 0.05)]
    rows += [(None, 5, 1.0, 1.0, "x", 0), ("0", None, 9.0, 1.0, "x", 0), ("0", 1000, None, 1.0, "x", 0)]
    bars = spark.createDataFrame(rows, "k string, at long, high double, low double, _chunk string, kind int")
    assert sorted(map(tuple, confirmed_pivots(bars, "k", "at", "high", "low", 0.05, width).collect())) == sorted(want)


def test_pivots_of_nothing(spark):
    bars = spark.createDataFrame([], "k string, at long, high double, low double")
    assert confirmed_pivots(bars, "k", "at", "high", "low", 0.05).count() == 0


@pytest.mark.parametrize("q", [0.5, 0.6, 0.7, 0.8])
def test_quantiles_to_the_last_bit(q):
    """A threshold between two prices may be a third one's price: it has to be the very double that SQL gets."""
    rng, sql = np.random.default_rng(3), duckdb.connect()
    for _ in range(60):
        values = np.sort(rng.integers(0, 50_000, rng.integers(2, 40)) / 100)
        want = sql.execute(f"SELECT quantile_cont(x, {q}) FROM (SELECT unnest(?) AS x)", [values.tolist()]).fetchone()[0]
        assert continuous(np.array([len(values)]), q, lambda k: values[k])[0] == want
