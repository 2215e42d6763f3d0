"""Books of trades: admission under a limit, and account value, by chunks of time whose edges are settled first.

What a chunk does depends on little of what came before: for admission on the trades still held (at most the limit) and the last
admitted signal; for the value of an account on its value and the stakes of open trades, in which it is linear. So chunks are
worked on in parallel, a table with a row a chunk settles what enters each, and no task has more trades than a chunk and the one
before it, however long a book stays open.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemill.streaming.sinks import settled


def admitted_of(t: np.ndarray, end: np.ndarray, cap: int, gap: int, held: list, last: int | None) -> tuple[np.ndarray, list, int | None]:
    """Flags of trades in order of signal t, with what is held and was admitted last before and after them."""
    taken, held = np.zeros(len(t), bool), sorted(held)
    k = int(np.searchsorted(t, last + gap)) if last is not None else 0
    while k < len(t) and cap > 0:
        while held and held[0] < t[k]:
            heapq.heappop(held)
        if len(held) == cap:  # nothing before the first of them has left
            k = int(np.searchsorted(t, held[0], "right"))
            continue
        taken[k] = True
        heapq.heappush(held, end[k])
        last = int(t[k])
        k = max(int(np.searchsorted(t, last + gap)), k + 1)
    return taken, sorted(int(x) for x in held), last


_STATE = "first long, held_in array<long>, last_in long, held_out array<long>, last_out long"


def admit(trades: DataFrame, by: str, signal: str, leave: str, cap: int, gap: int, chunk: int) -> DataFrame:
    """(by, id, admitted): greedy admission in order of signal, then id. At most cap admitted trades may be pending or open at a
    signal, and admitted signals are gap apart at least. A trade counts from its signal on, filled or not, and still counts at
    a signal at the very time it leaves.

    Each chunk first guesses what enters it by going through the chunk before it from an empty book: two books that see the same
    signals soon hold the same. Where the guess is not what the chunk before really leaves, the chunk is gone through again
    with that, until all edges agree; the first chunk's is right, so then all are. A round takes only the chunks that
    disagree. Trades with a null time or id are left out.

    With a gap, only the first trade of a signal's time can be admitted: if it is, the others are too near, and if it is not,
    they meet the same book. So a chunk's task has at most a row for each time in two chunks, however many trades there are;
    the others are refused as they are. Without a gap a task has all trades of two chunks.
    """
    kind = dict(trades.dtypes)[by]
    good = trades.select(by, F.col("id").cast("long").alias("id"), F.col(signal).cast("long").alias("t"), F.col(leave).cast("long").alias("end")).dropna().withColumn("_chunk", F.floor(F.col("t") / F.lit(chunk)))
    later = None
    if gap > 0:
        good = good.withColumn("_place", F.row_number().over(W.partitionBy(by, "t").orderBy("id")))
        later = good.where("_place > 1").select(by, "id", F.lit(False).alias("admitted"))
        good = settled(good.where("_place = 1").drop("_place"), "signals")

    def ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = table["t"].to_numpy()
        order = np.lexsort((table["id"].to_numpy(), t))
        return order, t[order], table["end"].to_numpy()[order]

    def enters(table: pa.Table) -> tuple[list, int | None]:
        return table["held_in"][0].as_py() or [], table["last_in"][0].as_py()

    def table_of(book: pa.ChunkedArray, rows: list[tuple]) -> pa.Table:
        long, longs = pa.int64(), pa.list_(pa.int64())
        columns = [pa.array([r[k] for r in rows], of) for k, of in enumerate((long, long, longs, long, longs, long))]
        return pa.Table.from_arrays([book, *columns], names=[by, "_chunk", "first", "held_in", "last_in", "held_out", "last_out"])

    def state(table: pa.Table, number: int, t: np.ndarray, end: np.ndarray, held: list, last: int | None) -> pa.Table:
        _, out, last_out = admitted_of(t, end, cap, gap, held, last)
        last = last if last is not None and t[0] - last < gap else None
        return table_of(table[by].slice(0, 1), [(number, int(t[0]), [x for x in held if x >= t[0]], last, out, last_out)])

    def guess(key: tuple, table: pa.Table) -> pa.Table:
        before, own = (table.filter(m) for m in (pc.invert(table["own"]), table["own"]))
        number = key[1].as_py()
        if not len(own):
            return table_of(table[by].slice(0, 0), [])
        _, held, last = admitted_of(*ordered(before)[1:], cap, gap, [], None)
        return state(own, number, *ordered(own)[1:], held, last)

    def again(table: pa.Table) -> pa.Table:
        return state(table, table["_chunk"][0].as_py(), *ordered(table)[1:], *enters(table))

    def judge(table: pa.Table) -> pa.Table:
        order, t, end = ordered(table)
        taken = np.zeros(len(t), bool)
        taken[order] = admitted_of(t, end, cap, gap, *enters(table))[0]
        return table.select([by, "id"]).append_column("admitted", pa.array(taken))

    schema = f"{by} {kind}, _chunk long, {_STATE}"
    both = F.explode(F.array(F.struct(F.col("_chunk").alias("c"), F.lit(True).alias("own")), F.struct((F.col("_chunk") + 1).alias("c"), F.lit(False).alias("own"))))
    dealt = good.withColumn("_at", both).select(by, "id", "t", "end", F.col("_at.c").alias("_task"), F.col("_at.own").alias("own"))
    edges = settled(dealt.groupBy(by, "_task").applyInArrow(guess, schema), "edges")
    while True:
        over = W.partitionBy(by).orderBy("_chunk")  # a row a chunk
        seen = edges.withColumn("_held", F.filter(F.coalesce(F.lag("held_out").over(over), F.array().cast("array<long>")), lambda x: x >= F.col("first"))).withColumn("_last", F.lag("last_out").over(over))
        seen = seen.withColumn("_last", F.when(F.col("first") - F.col("_last") < gap, F.col("_last")))
        wrong = seen.where(~(F.col("_held").eqNullSafe(F.col("held_in")) & F.col("_last").eqNullSafe(F.col("last_in"))))
        wrong = settled(wrong.select(by, "_chunk", F.col("_held").alias("held_in"), F.col("_last").alias("last_in")), "wrong")
        if wrong.isEmpty():
            judged = good.join(edges.select(by, "_chunk", "held_in", "last_in"), [by, "_chunk"]).groupBy(by, "_chunk").applyInArrow(judge, f"{by} {kind}, id long, admitted boolean")
            return judged if later is None else judged.unionByName(later)
        fixed = good.join(wrong, [by, "_chunk"]).groupBy(by, "_chunk").applyInArrow(again, schema)
        edges = settled(edges.join(wrong, [by, "_chunk"], "left_anti").select(fixed.columns).unionByName(fixed), "edges")


def chunk_values(frame: pd.DataFrame, inputs: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """One chunk of an account. frame has its exits (stake: risk times result) and the entries of trades that leave later.
    inputs has a row each for the value at its start and the base of each exit that entered before it; more columns are more
    cases at once. Returns the exits in order, base and value at each, and the base of each entry."""
    exits = frame[frame["exits"]].sort_values(["leave", "entry", "id"])
    entries = frame[~frame["exits"]].sort_values("id")
    out = exits["leave"].to_numpy()
    foreign = exits["foreign"].to_numpy(bool)
    value, base = np.empty((len(exits) + 1, inputs.shape[1])), np.empty((len(exits), inputs.shape[1]))
    value[0], given = inputs[0], iter(inputs[1:])
    staked = np.minimum(np.searchsorted(out, exits["entry"].to_numpy(), "right"), np.arange(len(out)))  # exits before the entry
    for k, (stake, at) in enumerate(zip(exits["stake"].to_numpy(float), staked)):
        base[k] = next(given) if foreign[k] else value[at]
        value[k + 1] = value[k] + stake * base[k]
    return exits.assign(_place=np.arange(len(exits))), base, value, entries, value[np.searchsorted(out, entries["entry"].to_numpy(), "right")]


def equity(trades: DataFrame, by: str, entry: str, leave: str, result: str, risk: float, chunk: int, start: float = 1.0) -> DataFrame:
    """(by, id, base, equity_after): account value at each entry, and after each exit, in order of leave, entry and id. The stake is
    risk times base, the value at entry, after the exits of that time; a trade that leaves no later than it enters stakes the
    value just before its exit.

    What leaves a chunk (its last value, and the bases of trades that stay open) is linear in what enters it, so each chunk gives
    its matrix: a row for each trade left open and a column for each that was open, at most as many as a book may hold at
    once. The matrices are applied in order; then each chunk is valued with what enters it. Ids are unique in a book;
    trades with a null time, id or result are left out.
    """
    kind = dict(trades.dtypes)[by]
    good = trades.select(by, "id", F.col(entry).cast("long").alias("entry"), F.col(leave).cast("long").alias("leave"), (F.lit(risk) * F.col(result)).cast("double").alias("stake")).dropna()
    place = lambda c: F.floor(F.col(c) / F.lit(chunk))
    earlier = place("entry") < place("leave")
    exits = good.select("*", earlier.alias("foreign"), F.lit(True).alias("exits"), place("leave").alias("_chunk"))
    entries = good.where(earlier).select("*", F.lit(False).alias("foreign"), F.lit(False).alias("exits"), place("entry").alias("_chunk"))
    events = exits.unionByName(entries)

    def matrix(frame: pd.DataFrame) -> pd.DataFrame:
        size = 1 + int((frame["exits"] & frame["foreign"]).sum())
        done, _, value, left, bases = chunk_values(frame, np.eye(size))
        rows = [np.concatenate([value[-1:], bases]).ravel().tolist()]
        return pd.DataFrame({by: [frame[by].iloc[0]], "_chunk": [int(frame["_chunk"].iloc[0])], "came": [done[done["foreign"]]["id"].tolist()], "stay": [left["id"].tolist()], "matrix": rows})

    def apply(frame: pd.DataFrame) -> pd.DataFrame:
        value, open_, out = start, {}, []
        frame = frame.sort_values("_chunk")
        for number, came, stay, cells in zip(frame["_chunk"], frame["came"], frame["stay"], frame["matrix"]):
            inputs = np.array([value, *(open_.pop(i) for i in came)])
            out.append((frame[by].iloc[0], number, inputs.tolist()))
            after = np.reshape(cells, (-1, len(inputs))) @ inputs
            value = float(after[0])
            open_.update(zip(stay, after[1:].tolist()))
        return pd.DataFrame(out, columns=[by, "_chunk", "inputs"])

    def valued(frame: pd.DataFrame) -> pd.DataFrame:
        done, base, value, _, _ = chunk_values(frame, np.array(frame["inputs"].iloc[0])[:, None])
        return pd.DataFrame({by: done[by], "id": done["id"], "base": base[:, 0], "equity_after": value[1:, 0]})

    maps = events.groupBy(by, "_chunk").applyInPandas(matrix, f"{by} {kind}, _chunk long, came array<long>, stay array<long>, matrix array<double>")
    inputs = settled(maps.groupBy(by).applyInPandas(apply, f"{by} {kind}, _chunk long, inputs array<double>"), "inputs")
    return events.join(inputs, [by, "_chunk"]).groupBy(by, "_chunk").applyInPandas(valued, f"{by} {kind}, id long, base double, equity_after double")
