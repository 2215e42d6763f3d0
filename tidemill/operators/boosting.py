"""Boosted trees on binned features, grown for several folds at once by sums over executors; the driver sees sums only.

Rows of one fold, part, label and features count as one with their number, so the input is read once to fit. A level of all folds'
trees is one pass over those: each batch works out where its rows stand by the trees so far, and gives sums of gradients by node,
feature and bin. Those are whole numbers, so they do not depend on how rows are dealt. The best split of each
node is found among the sums, of which there are folds x nodes x features x bins at most, whatever the rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemill.streaming.sinks import settled

#: Gradients are counted in parts of this size.
UNIT = 1e9
#: Parts of a fold: rows that trees are grown on, and those that say when to stop.
TRAIN, STOP = "train", "es"


@dataclass(frozen=True)
class Params:
    rounds: int = 8
    depth: int = 3
    rate: float = 0.3
    penalty: float = 1.0
    weight: float = 1.0
    patience: int = 2
    bins: int = 32

    def __post_init__(self):
        if min(self.rounds, self.depth, self.patience, self.bins) < 1 or min(self.rate, self.penalty) <= 0:
            raise ValueError("rounds, depth, patience, bins, rate and penalty must be positive")

    def key(self) -> str:
        """A name of these parameters."""
        return hashlib.sha1(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]


@dataclass
class Tree:
    """Node k has the children 2 k and 2 k + 1; rows with a bin up to the threshold go to the first. feature -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def nodes(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        while True:
            f = self.feature[node]
            if (f < 0).all():
                return node
            node = np.where(f < 0, node, 2 * node + (x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[node]))


@dataclass
class Model:
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    best: int = 0
    losses: list[float] = field(default_factory=list)

    def margin(self, x: np.ndarray, trees: int | None = None) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees[:trees]:
            out += tree.value[tree.nodes(x)]
        return out


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margin))


def _by_fold(batches) -> Iterator[tuple]:
    """(fold, rows' places, features, batch) for each fold in each batch."""
    for batch in batches:
        folds = batch.column("fold").to_numpy(zero_copy_only=False)
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), int)
        for fold in np.unique(folds).tolist():
            rows = np.flatnonzero(folds == fold)
            yield fold, rows, x[rows], batch


def _whole(x: np.ndarray) -> np.ndarray:
    return np.round(x * UNIT).astype(np.int64)


_SUMS = "fold long, node int, feature int, bin int, g long, h long"


def _sums(rows: DataFrame, models: dict[int, Model], growing: dict[int, Tree], bins: int) -> dict[tuple, tuple]:
    """Sums by (fold, node, feature, bin) of rows that stand for n each; node 0 has the loss on the rows that say when to stop, in g,
    and their number, in h."""

    def run(batches):
        for fold, at, x, batch in _by_fold(batches):
            if fold not in growing:
                continue
            y, part, n = (batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("y", "part", "n"))
            p = probability(models[fold].margin(x))
            out = []
            stop = part == STOP
            if stop.any():
                q = np.clip(p[stop], 1e-12, 1 - 1e-12)
                out.append((0, 0, 0, int((_whole(-np.where(y[stop] == 1, np.log(q), np.log(1 - q))) * n[stop]).sum()), int(n[stop].sum())))
            own = part == TRAIN
            node, g, h = growing[fold].nodes(x[own]), _whole(p[own] - y[own]) * n[own], _whole(p[own] * (1 - p[own])) * n[own]
            size = int(node.max(initial=0)) + 1
            for f in range(x.shape[1]):
                cell = node * bins + np.clip(x[own, f], 0, bins - 1)
                sums = np.zeros((2, size * bins), np.int64)
                np.add.at(sums[0], cell, g)
                np.add.at(sums[1], cell, h)
                for c in np.unique(cell).tolist():
                    out.append((c // bins, f, c % bins, int(sums[0][c]), int(sums[1][c])))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([fold] * len(out), pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["fold", "node", "feature", "bin", "g", "h"])

    found = rows.mapInArrow(run, _SUMS).groupBy("fold", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    return {tuple(r)[:4]: (r.g, r.h) for r in found}


def _split(sums: dict[tuple, tuple], fold: int, node: int, features: int, params: Params) -> tuple | None:
    """(feature, threshold, left g, left h, g, h) of the greatest gain; of equal ones the first feature and bin."""
    best, least = None, params.weight * UNIT
    score = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + params.penalty)
    for f in range(features):
        cells = [sums.get((fold, node, f, b), (0, 0)) for b in range(params.bins)]
        g, h = (sum(c[k] for c in cells) for k in (0, 1))
        left_g = left_h = 0
        for b, (cg, ch) in enumerate(cells[:-1]):
            left_g, left_h = left_g + cg, left_h + ch
            if left_h < least or h - left_h < least:
                continue
            gain = score(left_g, left_h) + score(g - left_g, h - left_h) - score(g, h)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                best = gain, (f, b, left_g, left_h, g, h)
    return best and best[1]


def fit(rows: DataFrame, features: int, params: Params) -> dict[int, Model]:
    """A model for each fold of rows (fold long, part, y 0 or 1, x: an array of so many bins). A fold's trees stop when the loss on
    its STOP rows has not fallen for `patience` rounds, and only those up to its best count; without such rows all do. Rows
    with a null are left out; a fold without TRAIN rows has no model."""
    rows = rows.select(F.col("fold").cast("long").alias("fold"), F.col("part").cast("string").alias("part"), F.col("y").cast("int").alias("y"), F.col("x").cast("array<int>").alias("x"))
    rows = rows.dropna().where(F.col("part").isin(TRAIN, STOP) & (F.size("x") == features))
    rows = settled(rows.groupBy("fold", "part", "y", "x").agg(F.count(F.lit(1)).alias("n")), "samples")
    start = rows.where(F.col("part") == TRAIN).groupBy("fold").agg(F.sum(F.col("y") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()  # a row a fold
    models = {r.fold: Model(float(np.log((r.good + 0.5) / (r.n - r.good + 0.5)))) for r in start}
    live, size = set(models), 2 ** (params.depth + 1)
    for _ in range(params.rounds + 1):
        growing = {k: Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for k in live}
        for level in range(params.depth):
            sums = _sums(rows, models, growing, params.bins)
            if level == 0:
                for k in sorted(live):
                    own, (loss, n) = models[k], sums.get((k, 0, 0, 0), (0, 0))
                    own.losses.append(loss / UNIT / n if n else -len(own.losses))
                    own.best = int(np.argmin(own.losses))
                    if len(own.trees) - own.best >= params.patience or len(own.trees) == params.rounds:
                        live.discard(k)
                        growing.pop(k)
            for k, tree in growing.items():
                for node in range(2**level, 2 ** (level + 1)):
                    found = _split(sums, k, node, features, params)
                    if found:
                        f, b, left_g, left_h, g, h = found
                        tree.feature[node], tree.threshold[node] = f, b
                        for child, cg, ch in ((2 * node, left_g, left_h), (2 * node + 1, g - left_g, h - left_h)):
                            tree.value[child] = -params.rate * cg / (ch + params.penalty * UNIT)
            if not growing:
                break
        for k, tree in growing.items():
            models[k].trees.append(tree)
        if not live:
            break
    return models


def predict(rows: DataFrame, models: dict[int, Model], number: str) -> DataFrame:
    """(fold, part, <number>, p) of rows (fold, part, <number> long, x) by each fold's trees up to its best."""

    def run(batches):
        for fold, at, x, batch in _by_fold(batches):
            if fold in models:
                take = pa.array(at)
                p = probability(models[fold].margin(x, models[fold].best))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("fold", "part", number)] + [pa.array(p)], names=["fold", "part", number, "p"])

    some = rows.select(F.col("fold").cast("long").alias("fold"), F.col("part").cast("string").alias("part"), F.col(number).cast("long").alias(number), F.col("x").cast("array<int>").alias("x")).dropna(subset=["fold", "x"])
    return some.mapInArrow(run, f"fold long, part string, {number} long, p double")


def walk_forward(rows: DataFrame, number: str, features: int, params: Params, cache: str) -> DataFrame:
    """predict() of all rows, each fold by its own model. Predictions are kept in the folder `cache` by parameters and fold; folds that
    are there already are read, not fitted again. The folder is one data set's and one label's."""
    spark, place = rows.sparkSession, f"{cache}/{params.key()}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    folds = sorted(r[0] for r in rows.select(F.col("fold").cast("long")).dropna().distinct().collect())  # a few
    missing = [k for k in folds if not files.exists(path(f"{place}/fold={k}/_SUCCESS"))]
    if missing:
        fresh = rows.where(F.col("fold").isin(missing))
        models = fit(fresh, features, params)
        for k in missing:
            predict(fresh.where(F.col("fold") == k), models, number).drop("fold").write.mode("overwrite").parquet(f"{place}/fold={k}")
    return spark.read.schema(f"part string, {number} long, p double, fold long").parquet(place)
