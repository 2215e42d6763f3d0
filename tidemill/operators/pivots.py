"""Confirmed turning points by composable chunks: what a chunk of bars makes of any leg that enters it is a small table.

A leg looks for a top (or, mirrored, a bottom). All that a chunk needs to know of the bars before is the leg's running extreme.
It stays as it is until the first bar that reaches it, or the first that comes back from it by the reversal; both are bars that
set a record since the chunk's start, and from such a bar on nothing before the chunk matters. So a chunk is a row a record,
with the leg that leaves the chunk after it. Only these rows are gone through in order; then each chunk is done with the leg
that enters it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemill.functions.ieee import over
from tidemill.operators.folds import running

BLOCK = 64


def _first(start: int, stop: int, test) -> int | None:
    """The first index from start to stop - 1 for which test(a, b), flags of a block a:b, holds; blocks double in size."""
    a, size = start, BLOCK
    while a < stop:
        b = min(a + size, stop)
        flags = test(a, b)
        if flags.any():
            return a + int(flags.argmax())
        a, size = b, size * 2
    return None


class Chunk:
    """Bars in order. A leg is (kind, best, at): kind 1 looks for a top, -1 for a bottom; best is its extreme so far, at the time
    of the last bar that reached it."""

    def __init__(self, t: np.ndarray, high: np.ndarray, low: np.ndarray, reversal: float):
        self.t, self.n, self.reversal = t, len(t), reversal
        self.sides = {1: (high, low), -1: (-low, -high)}  # a bottom is a top of mirrored prices
        self.left: dict[tuple[int, int], tuple] = {}

    def turn(self, leg: tuple, start: int) -> tuple[int | None, tuple]:
        """The first bar from start on that confirms the leg's extreme, or None, and the leg as it is then."""
        kind, best, at = leg
        ahead, back = self.sides[kind]
        reach = top = kind * best

        def test(a: int, b: int) -> np.ndarray:
            nonlocal reach
            before = np.maximum.accumulate(np.append(reach, ahead[a:b]))
            reach = before[-1]
            return (ahead[a:b] < before[:-1]) & (back[a:b] <= before[:-1] * (1 - kind * self.reversal))

        i = _first(start, self.n, test)
        seen = ahead[start : self.n if i is None else i]
        if len(seen) and seen.max() >= top:
            top = seen.max()
            at = int(self.t[start + int(np.flatnonzero(seen == top)[-1])])
        return i, (kind, float(kind * top), at)

    def fresh(self, kind: int, i: int) -> tuple:
        """A leg whose extreme is bar i."""
        return kind, float(kind * self.sides[kind][0][i]), int(self.t[i])

    def follow(self, leg: tuple, start: int) -> tuple[list[tuple], tuple]:
        """The pivots (time, confirmed, price, kind) that the bars from start on make of a leg, and the leg that is left."""
        out = []
        while True:
            i, leg = self.turn(leg, start)
            if i is None:
                return out, leg
            out.append((leg[2], int(self.t[i]), leg[1], leg[0]))
            leg, start = self.fresh(-leg[0], i), i + 1

    def leaves(self, kind: int, i: int) -> tuple:
        """The leg that leaves the chunk if one of this kind has its extreme at bar i."""
        path, state = [], (kind, i)
        while state not in self.left:
            path.append(state)
            j, leg = self.turn(self.fresh(*state), state[1] + 1)
            if j is None:
                self.left[state] = leg
            else:
                state = (-state[0], j)
        for s in path:
            self.left[s] = self.left[state]
        return self.left[state]

    def records(self) -> list[tuple]:
        """(kind, place, extreme, leg that leaves) of each record, of highs (kind 1) and lows (kind -1). Neighbouring records of
        one kind with one outcome and none of the other kind between are one row."""
        out = []
        for kind in (1, -1):
            ahead = self.sides[kind][0]
            best = np.maximum.accumulate(ahead)
            first = np.flatnonzero(np.concatenate([[True], best[1:] > best[:-1]]))
            out += [(int(i), kind, float(kind * ahead[i]), self.leaves(kind, int(i))) for i in first]
        merged: list[tuple] = []
        for i, kind, value, leg in sorted(out):
            if merged and merged[-1][1] == kind and merged[-1][3] == leg:
                merged[-1] = (merged[-1][0], kind, value, leg)
            else:
                merged.append((i, kind, value, leg))
        return [(kind, i, value, leg) for i, kind, value, leg in merged]


def entering(table: pd.DataFrame, reversal: float) -> list[tuple]:
    """(chunk, kind, best, at) for each chunk that a leg enters. table has the chunks' records, and of the first chunk the leg that
    leaves it (side 0)."""
    out, leg = [], None
    for chunk, rows in table.sort_values(["chunk", "place"]).groupby("chunk", sort=True):
        side, value = rows["side"].to_numpy(), rows["value"].to_numpy()
        after = list(zip(rows["kind"], rows["best"], rows["at"]))
        if leg is None:
            leg = after[0]
            continue
        out.append((int(chunk), *leg))
        kind, best = leg[0], leg[0] * leg[1]
        reached = (side == kind) & (kind * value >= best)
        turned = (side == -kind) & (kind * value <= best * (1 - kind * reversal))
        hits = np.flatnonzero(reached | turned)
        if len(hits):  # a bar that reaches the extreme is not tested
            leg = after[min(hits.tolist(), key=lambda r: (rows["place"].iloc[r], not reached[r]))]
    return out


def confirmed_pivots(bars: DataFrame, by: str, order: str, high: str, low: str, reversal: float, width: int = 3_600_000) -> DataFrame:
    """(by, pivot, confirmed, price, kind): turning points, each known only once the price has come back by reversal.

    Up to the first pivot both extremes are tracked (the earliest bar of each) and the larger swing wins, a rise if both are as
    large; after that a bar that reaches the running extreme moves it and is not tested. A chunk is `width` of time; no task
    has more than a chunk's bars, or a series' table of records. Bars with nulls are left out; times are unique; prices may be zero,
    from which any rise is endless.
    """
    good = bars.select(by, F.col(order).cast("long").alias("t"), F.col(high).cast("double").alias("high"), F.col(low).cast("double").alias("low")).dropna()
    chunk = F.floor(F.col("t") / F.lit(width))
    # the first pivot: running extremes, each with its earliest bar
    seen = running(good, [by], chunk, ["t"], maxes={"_top": F.struct(F.col("high").alias("v"), (-F.col("t")).alias("t")), "_bottom": F.struct((-F.col("low")).alias("v"), (-F.col("t")).alias("t"))})
    top, bottom = F.col("_top.v"), -F.col("_bottom.v")
    up, down = over(F.col("high"), bottom) - 1, 1 - over(F.col("low"), top)
    rose = (up >= reversal) & (up >= down) & (F.col("_bottom.t") != -F.col("t"))
    fell = (down >= reversal) & (F.col("_top.t") != -F.col("t"))
    first = seen.where(rose | fell).groupBy(by).agg(F.min(F.struct("t", F.when(rose, -1).otherwise(1).alias("kind"), F.when(rose, -F.col("_bottom.t")).otherwise(-F.col("_top.t")).alias("pivot"), F.when(rose, bottom).otherwise(top).alias("price"))).alias("_first"))
    live = good.join(first.select(by, F.col("_first.t").alias("_t0"), (-F.col("_first.kind")).alias("_kind0")), by).where("t >= _t0").withColumn("_chunk", chunk)

    def summary(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        own = Chunk(*(frame[c].to_numpy() for c in ("t", "high", "low")), reversal)
        starts = frame["t"].iloc[0] == frame["_t0"].iloc[0]
        rows = [(0, 0, 0.0, own.leaves(int(frame["_kind0"].iloc[0]), 0))] if starts else own.records()
        flat = [(frame[by].iloc[0], int(frame["_chunk"].iloc[0]), side, place, value, *leg) for side, place, value, leg in rows]
        return pd.DataFrame(flat, columns=[by, "chunk", "side", "place", "value", "kind", "best", "at"])

    def carried(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(frame[by].iloc[0], *row) for row in entering(frame, reversal)], columns=[by, "_chunk", "_kind", "_best", "_at"])

    def emitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        own, head = Chunk(*(frame[c].to_numpy() for c in ("t", "high", "low")), reversal), frame.iloc[0]
        if head["t"] == head["_t0"]:
            rows, _ = own.follow(own.fresh(int(head["_kind0"]), 0), 1)
        else:
            rows, _ = own.follow((int(head["_kind"]), float(head["_best"]), int(head["_at"])), 0)
        out = pd.DataFrame(rows, columns=["pivot", "confirmed", "price", "kind"])
        out.insert(0, by, head[by])
        return out

    kind = dict(bars.dtypes)[by]
    table = live.groupBy(by, "_chunk").applyInPandas(summary, f"{by} {kind}, chunk long, side int, place int, value double, kind int, best double, at long")
    legs = table.groupBy(by).applyInPandas(carried, f"{by} {kind}, _chunk long, _kind int, _best double, _at long")
    found = live.join(legs, [by, "_chunk"], "left").groupBy(by, "_chunk").applyInPandas(emitted, f"{by} {kind}, pivot long, confirmed long, price double, kind int")
    opening = first.select(by, F.col("_first.pivot").alias("pivot"), F.col("_first.t").alias("confirmed"), F.col("_first.price").alias("price"), F.col("_first.kind").alias("kind"))
    return opening.unionByName(found)
