"""The isolated account against a loop over trades and bars."""

import math
import random

import pytest

from tidemill.functions.futures import TIERS
from tidemill.operators.futures_account import Account, isolated_account
from tidemill.operators.simulate import Rules


def by_loop(bars, trades, rates, rules, account):
    """One trade after the other, each bar looked at with what the account is worth."""
    done, last = [], None
    for book, i, start, side, b in sorted((t for t in trades if None not in t), key=lambda t: (t[0], t[2], t[1])):
        done = [d for d in done if d["book"] == book] if done and done[-1]["book"] != book else done
        mine = [d for d in done if d["book"] == book]
        last = mine[-1]["start"] if mine else None
        path = bars[book][start : start + rules.hold] if 0 <= start < len(bars[book]) else []
        if not path or sum(d["exit_at"] >= start for d in mine) >= account.cap or (last is not None and start - last < account.gap):
            continue
        value = account.capital + sum(d["net"] for d in mine if d["exit_at"] < start)
        size = value * account.margin * account.leverage
        _, rate, amount, most = next((t for t in TIERS if size <= t[0]), TIERS[-1])
        entry, paid, out = path[0][0], 0.0, None
        for k, (o, h, low, c) in enumerate(path):
            if k:
                paid -= side * o / entry * rates.get(start + k, 0.0)
            gone = entry * (1 - side * (1 / account.leverage + paid + amount / size)) / (1 - side * rate)
            stop, target = entry * math.exp(-side * rules.sl * b), entry * math.exp(side * rules.tp * b)
            first = max(gone, stop) if side > 0 else min(gone, stop)
            if (low <= first) if side > 0 else (h >= first):
                out = (start + k, gone, "LIQ") if first == gone else (start + k, min(o, stop) if side > 0 else max(o, stop), "SL")
            elif (h >= target) if side > 0 else (low <= target):
                out = (start + k, target, "TP")
            if out:
                break
        if not out and len(path) < rules.hold:
            continue
        out = out or (start + len(path) - 1, path[-1][3], "TIMEOUT")
        fee = rules.maker if out[2] == "TP" else rules.taker
        net = size * (-1 / account.leverage if out[2] == "LIQ" else side * (out[1] / entry - 1) - out[1] / entry * fee + paid) - size * rules.taker
        risk = lambda d: d["size"] * (abs(1 - math.exp(-d["side"] * rules.sl * d["b"])) + d["rate"])
        row = {"book": book, "id": i, "start": start, "exit_at": out[0], "exit": out[1], "kind": out[2], "net": net, "size": size, "side": side, "b": b, "rate": rate, "base": value, "ok": most >= account.leverage}
        row["buffer"] = 100 * (value - sum(risk(d) for d in mine if d["exit_at"] >= start) - risk(row)) / value
        done.append(row)
        yield row


@pytest.mark.parametrize("seed,capital", [(1, 100_000.0), (2, 400_000.0)])
def test_isolated_account(spark, seed, capital):
    rng = random.Random(seed)
    bars = {}
    for book in "ab":
        price, bars[book] = 100.0, []
        for _ in range(160):
            first = price * math.exp(rng.gauss(0, 0.01))
            price = first * math.exp(rng.gauss(0, 0.02))
            bars[book].append((first, max(first, price) * (1 + rng.random() * 0.01), min(first, price) * (1 - rng.random() * 0.01), price))
    trades = [(rng.choice("ab"), i, rng.randrange(-2, 165), rng.choice([1, -1]), rng.choice([0.02, 0.04, 0.08])) for i in range(150)] + [("a", 900, None, 1, 0.02)]
    rates = {i: rng.choice([0.01, -0.01, 0.003]) for i in range(0, 160, 4)}
    rules, account = Rules(tp=1.5, sl=1.0, hold=12, maker=0.0002, taker=0.0005), Account(capital, 0.05, 20.0, 3, 2)
    frame = spark.createDataFrame([(k, i, *x) for k, rows in bars.items() for i, x in enumerate(rows)], "book string, i long, open double, high double, low double, close double")
    table = spark.createDataFrame(trades, "book string, id long, start long, side int, b double")
    found = isolated_account(frame, table, spark.createDataFrame(list(rates.items()), "i long, rate double"), "book", rules, account, 60).collect()
    want = {r["id"]: r for r in by_loop(bars, trades, rates, rules, account)}
    assert {r.id for r in found} == set(want) and {r["kind"] for r in want.values()} == {"LIQ", "SL", "TP", "TIMEOUT"}
    for r in found:
        w = want[r.id]
        assert (r.kind, r.exit_at, r.leverage_ok) == (w["kind"], w["exit_at"], w["ok"])
        assert all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6) for x, y in ((r.exit, w["exit"]), (r.net, w["net"]), (r.base, w["base"]), (r.notional, w["size"]), (r.buffer_pct, w["buffer"])))
