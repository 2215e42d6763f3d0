"""Packing token sequences as a cutting-stock problem solved by column generation (operator 8)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemill.llm.common import documents, input_columns, materialize
from tidemill.llm.tokens import encoder, tokenizer_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def bin_sizes(capacity: int) -> np.ndarray:
    """Size of the bin of each length 0..capacity: the length itself when short, else the next multiple of 4 or 8."""
    length = np.arange(capacity + 1)
    step = np.where(length <= 64, 1, np.where(length <= capacity // 4, 4, 8))
    return np.minimum(-(-length // step) * step, capacity)


def _cut(path: str, end_id: int, capacity: int, with_ids: bool):
    sizes = bin_sizes(capacity)

    def run(batches):
        enc, tail, task = encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows, ids = [], []
                for doc, text in zip(*(batch.column(c).slice(a, 1000).to_pylist() for c in (0, 1))):
                    blob = enc.encode(text) + tail
                    n = len(blob) // 4
                    for start in range(0, n, capacity):
                        piece = blob[4 * start : 4 * (start + capacity)]
                        size = int(sizes[len(piece) // 4])
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, task, size, int(seen[size])))
                        seen[size] += 1
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<i4"))
                kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "size", "local_rank"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern that fits (unbounded knapsack by dynamic programming): value and counts by size."""
    order = np.lexsort((-values, sizes))
    ahead = np.maximum.accumulate(np.concatenate([[1e-12], values[order]]))[:-1]
    order = order[values[order] > ahead]  # another size is never better than a smaller one of as much value
    s, v, best = sizes[order], values[order], np.zeros(capacity + 1)
    for size, value in zip(s.tolist(), v.tolist()):
        times = 1
        while times * size <= capacity:
            np.maximum(best[times * size :], best[: capacity + 1 - times * size] + times * value, out=best[times * size :])
            times *= 2
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0 and best[c] > 1e-12:
        fit = s <= c
        loss = best[c] - best[c - s[fit]] - v[fit]
        k = int(loss.argmin())
        counts[order[k]] += 1
        c -= s[k]
    return float(best[capacity]), counts


def inverted(a: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan elimination without BLAS, whose threads may hang in a driver process; singular: ValueError."""
    m = len(a)
    work = np.concatenate([a.astype(float), np.eye(m)], axis=1)
    for i in range(m):
        k = i + int(np.abs(work[i:, i]).argmax())
        if abs(work[k, i]) < 1e-12:
            raise ValueError("singular")
        work[[i, k]] = work[[k, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, m:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: counts by size) and how often to cut each, in real numbers, so that demand is met by few sequences.

    The linear program min sum(x), A x >= demand is solved by the revised simplex method; the knapsack prices columns. It
    ends when no pattern prices above 1, or when the total length or demand . duals / value, both of them lower bounds,
    prove the sum to be within gap of the optimum; or after a few rounds a size, with patterns that are valid as they are. Its size is that of the length histogram
    (some hundred bins), whatever the corpus.
    """
    m, volume = len(sizes), (demand * sizes).sum() / capacity
    columns, left = [np.zeros(m, np.int64) for _ in range(m)], demand.astype(float)
    for i in range(m - 1, -1, -1):  # a first basis: each pattern uses up one size and takes along smaller ones, largest first
        a, room = columns[i], capacity
        a[i] = room // sizes[i]
        room -= a[i] * sizes[i]
        times = max(left[i], 0.0) / a[i]
        for j in range(i - 1, -1, -1):
            if room >= sizes[j] and times > 0 and left[j] >= times:
                a[j] = min(room // sizes[j], int(left[j] / times))
                room -= a[j] * sizes[j]
        left = left - a * times
    cost, inverse = np.ones(m), inverted(np.array(columns, float).T)
    x = np.maximum((inverse * demand).sum(1), 0)
    for k in range(4 * m + 100):
        if k % 64 == 63:  # against rounding errors
            try:
                inverse = inverted(np.array(columns, float).T)
            except ValueError:  # any patterns found so far are valid; the rest goes by largest fit
                break
            x = np.maximum((inverse * demand).sum(1), 0)
        if (cost * x).sum() <= volume * (1 + gap):
            break
        duals = (cost[:, None] * inverse).sum(0)
        worst = int(duals.argmin())
        if duals[worst] < -1e-9:
            entering, price_of = np.zeros(m, np.int64), 0.0
            entering[worst] = -1
        else:
            value, entering = price(np.maximum(duals, 0), sizes, capacity)
            if value <= 1 + 1e-9 or (cost * x).sum() * (1 - 1 / value) <= gap * max(1.0, (cost * x).sum()):
                break
            price_of = 1.0
        step = (inverse * entering).sum(1)
        ratio = np.where(step > 1e-7, x / np.where(step > 1e-7, step, 1), np.inf)
        out = int(np.lexsort((-step, ratio))[0])
        if not np.isfinite(ratio[out]):
            break
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        columns[out], cost[out] = entering, price_of
        x = np.maximum((inverse * demand).sum(1), 0)
    used = [i for i in range(m) if cost[i] > 0 and 0 < x[i] < np.inf]
    return np.array([columns[i] for i in used]).reshape(len(used), m), x[used]


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to cut each, in whole numbers, meeting demand exactly: rounded down, the rest by largest fit."""
    if not len(sizes):
        return []
    patterns, x = column_generation(sizes, demand.astype(float), capacity)
    left, plan = demand.copy(), []
    for a, times in zip(patterns, np.floor(x + 1e-6).astype(np.int64)):
        fits = int(min([times, *(left[a > 0] // a[a > 0])]))  # the covering program may cut more than is asked for
        if fits > 0:
            plan.append((a, fits))
            left = left - a * fits
    while left.any():
        a, room = np.zeros_like(left), capacity
        for i in np.argsort(-sizes, kind="stable"):
            a[i] = min(left[i], room // sizes[i])
            room -= a[i] * sizes[i]
        times = int((left[a > 0] // a[a > 0]).min())
        plan.append((a, times))
        left = left - a * times
    return plan


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most capacity tokens: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids if wanted.

    A document (its ids, then end_id) is cut into full sequences and one rest. Rests are counted by length on the driver
    (a histogram of some hundred bins at most); column generation finds the patterns; each rest's rank within its bin then
    gives its sequence and slot by arithmetic. Ranks come from running counts per task and a prefix sum over tasks, so no
    task orders a whole bin. Null texts are empty and have one id; null and repeated doc_ids are packed like any others;
    other columns are ignored; an empty table has no pieces. A bin's rests differ in length by less than the bin's step,
    so padding is what the patterns leave, plus under 8 ids a piece, 0.4 % here.
    """
    spark = docs.sparkSession
    schema = PIECES + ", task int, size int, local_rank long" + (", ids array<int>" if with_ids else "")
    pieces = materialize(input_columns(docs, id_col, text_col).mapInArrow(_cut(vocabulary, end_id, capacity, with_ids), schema), "pieces")
    counts = pieces.groupBy("task", "size").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("task", "size", (F.sum("n").over(W.partitionBy("size").orderBy("task")) - F.col("n")).alias("before"))
    totals = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # a row a bin
    full = totals.pop(capacity, 0)
    sizes = np.array(sorted(totals), np.int64)
    plan = whole_patterns(sizes, np.array([totals[s] for s in sizes.tolist()], np.int64), capacity)
    taken, sequence, ranges = dict.fromkeys(sizes.tolist(), 0), full, []
    for a, times in plan:
        slot = 0
        for i in np.flatnonzero(a):
            size, each = int(sizes[i]), int(a[i])
            ranges.append((size, taken[size], taken[size] + times * each, sequence, each, slot))
            taken[size] += times * each
            slot += each
        sequence += times
    slots = spark.createDataFrame(ranges, "size int, from_rank long, to_rank long, first_sequence long, each long, first_slot long")
    ranked = pieces.join(before, ["task", "size"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    whole = ranked.where(F.col("size") == capacity).withColumn("sequence_id", F.col("rank")).withColumn("offset", F.lit(0).cast("long"))
    within = F.col("rank") - F.col("from_rank")
    rest = (
        ranked.where(F.col("size") < capacity)
        .join(F.broadcast(slots), (ranked["size"] == slots["size"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(within / F.col("each")).cast("long"))
        .withColumn("slot", F.col("first_slot") + F.pmod(within, F.col("each")))
        .withColumn("offset", F.sum("length").over(W.partitionBy("sequence_id").orderBy("slot")) - F.col("length"))
    )  # a sequence has capacity pieces at most
    return whole.select(out).unionByName(rest.select(out))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())
