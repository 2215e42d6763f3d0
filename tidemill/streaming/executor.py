"""A live executor of trades: bars arrive as a stream, state holds the trades of an instrument that are not closed yet."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.operators.simulate import Rules

OUT = "instrument string, id long, entry_at long, entry double, exit_at long, exit double, kind string"
STATE = "book string"


def advance(trade: dict, bar: tuple, rules: Rules) -> tuple | None:
    """(exit, kind) if the bar (i, open, high, low, close) ends the trade; else None, and the trade is a bar older."""
    i, first, high, low, close = bar
    side, b = trade["side"], trade["b"]
    if "entry" not in trade:
        trade["entry"], trade["at"], trade["held"] = first, i, 0
    target, stop = trade["entry"] * math.exp(side * rules.tp * b), trade["entry"] * math.exp(-side * rules.sl * b)
    against, along = (low, high) if side > 0 else (-high, -low)  # a short is a long on mirrored prices
    if against <= stop * side:
        return (min(first * side, stop * side) * side, "SL")
    if along >= target * side:
        return (target, "TP")
    trade["held"] += 1
    return (close, "TIMEOUT") if trade["held"] == rules.hold else None


def execute(bars: DataFrame, rules: Rules) -> DataFrame:
    """Closed trades of a stream of bars (instrument, i, open, high, low, close, side, b): each bar with a side signals a trade that
    enters at the next bar's open. Bars of an instrument must come in order over batches; one that was seen before has no
    second effect. Trades still open when the stream ends are in the state, and in no result."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = json.loads(state.get[0]) if state.exists else {"last": None, "open": []}
        closed = []
        rows = pd.concat(list(frames)).sort_values("i")
        for i, first, high, low, close, side, b in rows[["i", "open", "high", "low", "close", "side", "b"]].itertuples(index=False):
            if book["last"] is not None and i <= book["last"]:
                continue
            still = []
            for trade in book["open"]:
                end = advance(trade, (i, first, high, low, close), rules)
                if end is None:
                    still.append(trade)
                else:
                    closed.append((key[0], trade["id"], trade["at"], trade["entry"], i, *end))
            if side:
                still.append({"id": int(i) * 10 + (1 if side > 0 else 0), "side": int(side), "b": float(b)})
            book = {"last": int(i), "open": still}
        state.update((json.dumps(book, default=float),))
        yield pd.DataFrame(closed, columns=["instrument", "id", "entry_at", "entry", "exit_at", "exit", "kind"]).astype({"id": "int64", "entry_at": "int64", "exit_at": "int64"})

    return bars.groupBy("instrument").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
