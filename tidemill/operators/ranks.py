"""Order statistics of sliding time frames: a row costs a logarithm of its frame, whatever the frame holds.

A series is dealt over blocks of time as long as the frame: a block's task gets the block's rows and those of the block before, which
is all that any frame of the block can reach. In it, ranks are kept by bits: for each bit of a value's rank, counts of the rows
so far that have it unset. The k-th smallest of any stretch of rows is then found bit by bit, for all rows of the block at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType


class Ranks:
    """Values in a fixed order; kth(lo, hi, k) is the k-th smallest (from 0) of those at lo to hi - 1, for arrays of queries."""

    def __init__(self, values: np.ndarray):
        self.sorted, rank = np.unique(values, return_inverse=True)
        self.bits = max(int(len(self.sorted) - 1).bit_length(), 1) if len(values) else 0
        self.unset, self.zeros = [], []
        for bit in reversed(range(self.bits)):
            one = (rank >> bit & 1).astype(bool)
            self.unset.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            self.zeros.append(int(self.unset[-1][-1]))
            rank = np.concatenate([rank[~one], rank[one]])  # rows with the bit unset come first, in order

    def step(self, level: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.unset[level][lo], self.unset[level][hi]

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.sorted[_descend([self], [lo], [hi], k)]


def _descend(tables: list[Ranks], lo: list[np.ndarray], hi: list[np.ndarray], k: np.ndarray) -> np.ndarray:
    """Rank of the k-th smallest over several stretches, each in a table of the same values in another order."""
    lo, hi, k, found = list(lo), list(hi), k.copy(), np.zeros(len(k), np.int64)
    for level in range(tables[0].bits):
        below = [t.step(level, a, b) for t, a, b in zip(tables, lo, hi)]
        unset = np.sum([b - a for a, b in below], axis=0)
        right = k >= unset
        k -= np.where(right, unset, 0)
        found = found << 1 | right
        for s, (t, (a, b)) in enumerate(zip(tables, below)):
            lo[s] = np.where(right, t.zeros[level] + lo[s] - a, a)
            hi[s] = np.where(right, t.zeros[level] + hi[s] - b, b)
    return found


class GatedRanks:
    """Pairs (gate, value) in a fixed order: counts and k-th smallest values of those at lo to hi - 1 whose gate is at least a
    query's own. The rows are in blocks of 1, 2, 4, ... rows; each size has its own table in which a block's rows are in
    descending order of gate, so that those that pass are the block's first ones. A stretch is two blocks of each size at most."""

    def __init__(self, gate: np.ndarray, value: np.ndarray):
        n, self.levels = len(gate), []
        self.gates, rank = np.unique(gate, return_inverse=True)
        high = len(self.gates)
        for level in range(n.bit_length()):
            key = (np.arange(n) >> level) * (high + 1) + (high - rank)
            order = np.argsort(key, kind="stable")
            self.levels.append((key[order], Ranks(value[order])))

    def stretches(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> tuple[list, list, list, np.ndarray]:
        """The tables, starts and ends of each query's passing rows, and how many they are."""
        high, passing = len(self.gates), np.searchsorted(self.gates, least)
        a, b, tables, starts, ends = lo.copy(), np.maximum(hi, lo), [], [], []
        for level, (keys, ranks) in enumerate(self.levels):
            for use, block in (((a & 1 == 1) & (a < b), a), ((b & 1 == 1) & (a < b), b - 1)):
                start = np.where(use, block << level, 0)
                end = np.where(use, np.searchsorted(keys, block * (high + 1) + (high - passing), "right"), 0)
                tables.append(ranks)
                starts.append(start)
                ends.append(np.maximum(end, start))
                if block is a:
                    a = a + use
            b = b - (b & 1)
            a, b = a >> 1, b >> 1
        return tables, starts, ends, np.sum([e - s for s, e in zip(starts, ends)], axis=0) if tables else np.zeros(len(lo), np.int64)


def interpolated(count: np.ndarray, q: float, kth) -> np.ndarray:
    """The linearly interpolated quantile of count > 0 values each, by kth(k)."""
    place = q * (count - 1)
    low = np.floor(place).astype(np.int64)
    a, b = kth(low), kth(np.minimum(low + 1, count - 1))
    return a + (b - a) * (place - low)


def continuous(count: np.ndarray, q: float, kth) -> np.ndarray:
    """The same to the last bit as SQL's quantile_cont gives it (DuckDB's: one fused step, rounded once), as thresholds are met exactly."""
    place = q * (count - 1)
    low = np.floor(place).astype(np.int64)
    a, b, d = kth(low), kth(np.minimum(low + 1, count - 1)), place - low
    return np.fromiter(map(math.fma, a.tolist(), (1 - d).tolist(), (b * d).tolist()), float, len(a))


def frames(time: np.ndarray, data: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in data (sorted times) of the frame [t - window, t) of each time."""
    return np.searchsorted(data, time - window), np.searchsorted(data, time)


def _by_blocks(rows: DataFrame, by: list[str], order: str, window: int, own, fields: list[StructField]) -> DataFrame:
    """rows with what own(frame of a block's rows, all rows it may look at) gives. Rows without a time are left out."""
    block = F.floor(F.col(order) / F.lit(window))
    dealt = rows.where(F.col(order).isNotNull()).withColumn("_at", F.explode(F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own")))))
    dealt = dealt.select(*rows.columns, F.col("_at.b").alias("_block"), F.col("_at.own").alias("_own"))
    schema = StructType(rows.schema.fields + fields)
    columns = rows.columns

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(order, kind="stable")
        mine = table[table["_own"]]
        found = own(mine, table) if len(mine) else {f.name: np.empty(0, object) for f in fields}
        return mine[columns].assign(**found)

    return dealt.groupBy(*by, "_block").applyInPandas(run, schema)


def rolling_quantiles(rows: DataFrame, by: list[str], order: str, value: str, window: int, quantiles: list[float], least: int, name: str = "q", least_rows: int = 0, mask: str | None = None) -> DataFrame:
    """rows with <name>, the quantiles of value over the rows of by in [t - window, t) (null if there are fewer than `least`), and
    <name>_n, how many there are. With a mask only rows where it holds are counted, and there is no result either if the
    frame has fewer than least_rows rows at all. Rows whose value is null are in no frame."""

    def own(mine: pd.DataFrame, table: pd.DataFrame) -> dict:
        t, x, at = table[order].to_numpy(), table[value].to_numpy(float), mine[order].to_numpy()
        known = ~np.isnan(x)
        good = known & (table[mask].fillna(False).to_numpy(bool) if mask else True)
        lo, hi = frames(at, t[good], window)
        all_lo, all_hi = frames(at, t[known], window)
        count = hi - lo
        ok, ranks = np.flatnonzero((count >= max(least, 1)) & (all_hi - all_lo >= least_rows)), Ranks(x[good])
        got = [continuous(count[ok], q, lambda k: ranks.kth(lo[ok], hi[ok], k)) for q in quantiles]
        return _listed(name, len(at), count, ok, got)

    return _by_blocks(rows, by, order, window, own, [StructField(name, ArrayType(DoubleType())), StructField(f"{name}_n", LongType())])


def gated_quantiles(rows: DataFrame, by: list[str], order: str, gate: str, value: str, threshold: str, window: int, quantiles: list[float], least: int, least_hits: int, name: str = "q") -> DataFrame:
    """rows with <name>, the quantiles of value over the rows of by in [t - window, t) whose gate is at least this row's threshold, and
    <name>_n, how many there are. Null if the frame has fewer than `least` rows or `least_hits` such rows, or without a
    threshold. Rows whose gate or value is null are in no frame. A block's tables take some n log(n)**2 numbers of four
    bytes, n its rows: 60 MB for 50,000, the rows of two frames of 90 days of 5 minutes."""

    def own(mine: pd.DataFrame, table: pd.DataFrame) -> dict:
        good = table[[gate, value]].notna().all(axis=1).to_numpy()
        t, g, x = (table[c].to_numpy()[good] for c in (order, gate, value))
        at, least_gate = mine[order].to_numpy(), mine[threshold].to_numpy(float)
        lo, hi = frames(at, t, window)
        ask = np.flatnonzero((hi - lo >= max(least, 1)) & ~np.isnan(least_gate))
        count = np.zeros(len(at), np.int64)
        tables, starts, ends, count[ask] = GatedRanks(g.astype(float), x.astype(float)).stretches(lo[ask], hi[ask], least_gate[ask])
        use = count[ask] >= max(least_hits, 1)
        starts, ends, ok = [s[use] for s in starts], [e[use] for e in ends], ask[use]
        got = [interpolated(count[ok], q, lambda k: tables[0].sorted[_descend(tables, starts, ends, k)]) for q in quantiles] if len(ok) else []
        return _listed(name, len(at), count, ok, got)

    return _by_blocks(rows, by, order, window, own, [StructField(name, ArrayType(DoubleType())), StructField(f"{name}_n", LongType())])


def _listed(name: str, n: int, count: np.ndarray, ok: np.ndarray, got: list[np.ndarray]) -> dict:
    out = np.full(n, None, object)
    for i, row in zip(ok.tolist(), np.transpose(got).tolist() if len(ok) else []):
        out[i] = row
    return {name: out, f"{name}_n": count}
