"""Trees grown by sums over executors against a grower that goes through all rows in one process."""

import math

import pytest
from pyspark.sql import functions as F

from oracle import SF
from tidemill.operators import boosting
from tidemill.operators.boosting import Params, fit, predict, walk_forward
from tidemill.plans.fits import FEATURES, samples


class Plain:
    """A fold's trees by recursion over lists of rows, each split judged by gains of its two sides."""

    def __init__(self, rows, params):
        self.params, self.trees = params, []
        self.train, self.stop = ([r for r in rows if r["part"] == p] for p in ("train", "es"))
        good = sum(r["y"] for r in self.train)
        self.base = math.log((good + 0.5) / (len(self.train) - good + 0.5))
        losses = []
        while True:
            losses.append(self.loss() if self.stop else -len(self.trees))
            self.best = losses.index(min(losses))
            if len(self.trees) - self.best >= params.patience or len(self.trees) == params.rounds:
                break
            scored = [(r["x"], self.p(r["x"]) - r["y"], self.p(r["x"]) * (1 - self.p(r["x"]))) for r in self.train]
            self.trees.append(self.grow(scored, params.depth))

    def p(self, x, trees=None):
        return 1 / (1 + math.exp(-self.base - sum(self.value(t, x) for t in self.trees[:trees])))

    def loss(self):
        return sum(-math.log(self.p(r["x"]) if r["y"] else 1 - self.p(r["x"])) for r in self.stop) / len(self.stop)

    def value(self, tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def grow(self, rows, depth):
        total = lambda some: (sum(r[1] for r in some), sum(r[2] for r in some))
        score = lambda some: total(some)[0] ** 2 / (total(some)[1] + self.params.penalty)
        leaf = -self.params.rate * total(rows)[0] / (total(rows)[1] + self.params.penalty)
        best = None
        for f in range(len(rows[0][0])) if depth else ():
            for b in sorted({r[0][f] for r in rows}):
                sides = [r for r in rows if r[0][f] <= b], [r for r in rows if r[0][f] > b]
                if min(total(s)[1] for s in sides) >= self.params.weight:
                    gain = sum(map(score, sides)) - score(rows)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, b, sides
        if best is None:
            return leaf if depth < self.params.depth else 0.0
        return best[1], best[2], *(self.grow(s, depth - 1) for s in best[3])


@pytest.mark.parametrize("params", [Params(rounds=4, depth=2, bins=16), Params(rounds=6, depth=3, rate=1.0, weight=4.0, patience=1, bins=16)])
def test_equal_to_one_process(spark, params):
    hidden = ((F.col("x")[0] >= 6) | (F.col("x")[1] > 8)).cast("int")
    rows = samples(spark, SF, "open").withColumn("y", F.when(F.col("o_orderkey") % 5 == 0, 1 - hidden).otherwise(hidden)).repartition(5)
    models = fit(rows, FEATURES, params)
    listed = [r.asDict() for r in rows.collect()]
    found = {(r.fold, r.o_orderkey): r.p for r in predict(rows, models, "o_orderkey").collect()}
    assert len(found) == len(listed)
    for fold, model in models.items():
        own = Plain([r for r in listed if r["fold"] == fold], params)
        assert (model.best, len(model.trees)) == (own.best, len(own.trees)) and own.best > 0
        for r in listed:
            if r["fold"] == fold:
                assert math.isclose(found[fold, r["o_orderkey"]], own.p(r["x"], own.best), rel_tol=1e-5)


def test_cases(spark, tmp_path):
    """Nulls, a fold without rows to stop on, one class only, no rows; and folds that are kept are not fitted again."""
    schema = "fold int, part string, y int, x array<int>, id long, p string"
    rows = [(1, "train", i % 2, [i % 2, i % 3], i, "x") for i in range(40)] + [(2, "train", 1, [i, 0], i, "x") for i in range(8)] + [(1, "train", None, [1, 1], 90, "x"), (1, "train", 1, None, 91, "x"), (None, "train", 1, [1, 1], 92, "x"), (3, "test", 1, [1, 1], 93, "x")]
    table, params = spark.createDataFrame(rows, schema), Params(rounds=3, depth=1, bins=8)
    models = fit(table, 2, params)
    assert set(models) == {1, 2} and models[1].best == 3 and models[1].trees[0].feature[1] == 0
    assert fit(table.limit(0), 2, params) == {}
    place = str(tmp_path / "kept")
    first = sorted(map(tuple, walk_forward(table, "id", 2, params, place).collect()))
    changed = table.withColumn("y", 1 - F.col("y"))
    assert first and sorted(map(tuple, walk_forward(changed, "id", 2, params, place).collect())) == first
    assert sorted(map(tuple, walk_forward(changed, "id", 2, Params(rounds=2, depth=1, bins=8), place).collect())) != first


def test_levels_go_over_distinct_rows(spark, monkeypatch):
    """A level's pass has as many rows as there are different ones, however often each is there; the trees are the same."""
    taken, sums, params = [], boosting._sums, Params(rounds=3, depth=2, bins=8)
    monkeypatch.setattr(boosting, "_sums", lambda rows, *more: taken.append(rows.count()) or sums(rows, *more))
    rows = spark.range(1200).selectExpr("1 AS fold", "if(id % 3 = 0, 'es', 'train') AS part", "CAST(id % 5 = 0 OR id % 7 = 1 AS INT) AS y", "array(id % 5, id % 7) AS x")
    once, often = fit(rows, 2, params)[1], fit(rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(9)))).where("r < 5 OR part = 'es'"), 2, params)[1]
    assert set(taken) == {len({(i % 3 == 0, i % 5 == 0 or i % 7 == 1, i % 5, i % 7) for i in range(1200)})}
    assert [t.feature.tolist() for t in once.trees] == [t.feature.tolist() for t in often.trees] and once.best == often.best


def test_many_equal_rows_are_summed_exactly(spark):
    """Sums of gradients of a billion equal rows, which no double holds to the unit."""
    model, n = boosting.Model(0.123), 10**9 + 7
    rows = spark.createDataFrame([(1, "train", 1, [0], n), (1, "train", 0, [0], 3)], "fold long, part string, y int, x array<int>, n long")
    p = float(boosting.probability(model.margin(boosting.np.zeros((1, 1), int)))[0])
    growing = {1: boosting.Tree(boosting.np.full(4, -1), boosting.np.zeros(4, int), boosting.np.zeros(4))}
    assert boosting._sums(rows, {1: model}, growing, 8)[1, 1, 0, 0][0] == round((p - 1) * 1e9) * n + round(p * 1e9) * 3
