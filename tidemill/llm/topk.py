"""Exact inner-product top-k by branch and bound over a ball tree per shard (operator 5)."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemill.llm.common import documents, materialize

#: Vectors of a shard at most, vectors of a leaf, queries of a block at most.
SHARD, LEAF_ROWS, BLOCK = 32_768, 128, 4096
#: Shards of a round for each shard of all rounds before.
GROWTH = 3


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) with v = floor(64 * component); rows without an id, a vector, or all components finite are left out. Rows
    that repeat others stay."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite
    v = F.transform(vector_col, lambda x: F.floor(F.lit(64.0) * x.cast("double")))
    return rows.where(good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists as a matrix; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(n.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().to_numpy()
    return out


def _save(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def _small(v: np.ndarray) -> np.ndarray:
    top = int(np.abs(v).max(initial=0))
    return v.astype(np.int8 if top < 128 else np.int16 if top < 1 << 15 else np.int64)


def ball_tree(ids: np.ndarray, v: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Balls (centre, radius, parent) over rows start:end of the reordered vectors; a ball without children is a leaf."""
    order, nodes = np.arange(len(v)), []
    stack = [(0, len(v), -1)]
    x = v.astype(np.float64)
    while stack:
        a, b, parent = stack.pop()
        part = x[order[a:b]]
        centre = part.mean(0)
        from_centre = np.linalg.norm(part - centre, axis=1)
        radius = from_centre.max()
        nodes.append((a, b, parent, radius, centre, b - a <= leaf or radius == 0))
        if not nodes[-1][-1]:
            far = part[from_centre.argmax()]
            other = part[np.linalg.norm(part - far, axis=1).argmax()]
            along = part @ (other - far)
            order[a:b] = order[a:b][np.argsort(along, kind="stable")]
            middle = (a + b) // 2
            stack += [(a, middle, len(nodes) - 1), (middle, b, len(nodes) - 1)]
    start, end, parent, radius, centre, is_leaf = zip(*nodes)
    return {
        "ids": ids[order], "v": _small(v[order]), "start": np.array(start), "end": np.array(end), "parent": np.array(parent),
        "radius": np.array(radius), "centre": np.array(centre), "leaf": np.array(is_leaf),
    }


def search(tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, (row, vec_id), score) of each query's k best in the tree that reach kth, its k-th best score so far; ids are
    the queries' own rows, and the tree's ids are pairs of row and vec_id.

    A ball's inner products are at most q . centre + |q| radius, and no more than its parent's bound. Each query visits
    leaves in descending order of that bound, until it falls below the query's k-th score, which rises on the way; a
    leaf's visitors of one round share a matrix product. Equal scores go to smaller ids, so ties are visited.
    """
    width = max(queries.shape[1], tree["v"].shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    v, q, centre = wide(tree["v"]), wide(queries), wide(tree["centre"])
    largest = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(width, 1)
    kind = np.float64 if largest < 2**53 else np.int64
    v, q = v.astype(kind), q.astype(kind)
    real = q.astype(np.float64)
    bound = real @ centre.T + np.linalg.norm(real, axis=1)[:, None] * tree["radius"]
    bound += 1e-6 * (1 + np.abs(bound))  # rounding
    for node, parent in enumerate(tree["parent"].tolist()):
        if parent >= 0:
            np.minimum(bound[:, node], bound[:, parent], out=bound[:, node])
    leaves = np.flatnonzero(tree["leaf"])
    bound = bound[:, leaves]
    order = np.argsort(-bound, axis=1, kind="stable")
    none = np.iinfo(np.int64).min
    best, who = np.full((len(q), k), none), np.full((len(q), k, 2), np.iinfo(np.int64).max)
    kth, live = kth.copy(), np.arange(len(q))
    for turn in range(len(leaves)):
        live = live[bound[live, order[live, turn]] >= kth[live]]
        if not len(live):
            break
        visits = order[live, turn]
        for leaf in np.unique(visits):
            rows, a, b = live[visits == leaf], tree["start"][leaves[leaf]], tree["end"][leaves[leaf]]
            score, found = np.rint(q[rows] @ v[a:b].T).astype(np.int64), tree["ids"][a:b]
            score[(score < kth[rows, None]) | (found[None, :, 0] == ids[rows, None])] = none
            better = score.max(1) > none
            rows, score = rows[better], score[better]
            if not len(rows):
                continue
            score = np.concatenate([best[rows], score], axis=1)
            name = np.concatenate([who[rows], np.broadcast_to(found, (len(rows), *found.shape))], axis=1)
            top = np.lexsort((name[:, :, 0], name[:, :, 1], -score.astype(np.float64) if kind is np.float64 else ~score), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(score, top, 1), np.take_along_axis(name, top[:, :, None], 1)
            kth[rows] = np.maximum(kth[rows], best[rows, -1])
    row, slot = np.nonzero(best > none)
    return row, who[row, slot], best[row, slot]


def _ball(v: np.ndarray) -> tuple[np.ndarray, float]:
    centre = v.mean(0) if len(v) else np.zeros(v.shape[1])
    return centre, float(np.linalg.norm(v - centre, axis=1).max(initial=0))


def _build(table):
    tree = ball_tree(np.stack([table["row"].to_numpy(), table["vec_id"].to_numpy()], axis=1), _matrix(table["v"]))
    root = {"centre": pa.array([tree["centre"][0]], pa.list_(pa.float64())), "radius": pa.array([float(tree["radius"][0])])}
    return pa.table({"shard": table["shard"].slice(0, 1), "tree": pa.array([_save(**tree)], pa.binary()), **root})


def _block(table):
    v, kth = _matrix(table["v"]), table["kth"].to_numpy()
    centre, radius = _ball(v.astype(np.float64))
    blob = _save(ids=np.stack([table["row"].to_numpy(), table["vec_id"].to_numpy()], axis=1), v=_small(v), kth=kth)
    return pa.table({
        "block": table["block"].slice(0, 1), "queries": pa.array([blob], pa.binary()), "at": pa.array([centre], pa.list_(pa.float64())),
        "reach": pa.array([radius]), "least": pa.array([int(kth.min())], pa.int64()),
    })


def _visit(k: int):
    def run(left, right):
        out = []
        for tree in left["tree"]:
            tree = dict(np.load(io.BytesIO(tree.as_py())))
            for block in right["queries"]:
                block = dict(np.load(io.BytesIO(block.as_py())))
                row, vec, score = search(tree, block["ids"][:, 0], block["v"], block["kth"], k)
                out.append(pa.table({"row": block["ids"][row, 0], "query_id": block["ids"][row, 1], "found": vec[:, 0], "vec_id": vec[:, 1], "score": score}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("row", "query_id", "found", "vec_id", "score")})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id", "found"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _dot(a: str, b: str) -> Column:
    """Inner product of two lists, the shorter one ending in zeros."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda total, x: total + x)


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row, the k rows of highest integer inner product, ties to smaller ids.

    Vectors are dealt into shards, each with a ball tree; queries into blocks. Blocks search the shards in rounds, each of
    GROWTH times as many shards as all before: a query's k-th score so far goes along to all shards of the next round, whose
    branches it prunes and which return only what may still be among the best, so about k * GROWTH rows a query and round.
    A round's tiles (block, shard) where no query can reach its k-th score, as the balls around all queries of the block and
    all vectors of the shard prove, are left out before anything is sent. A task holds one tree and one block, both of
    bounded size, whatever the table's; blocks times shards is the work of a search for a stated query set.

    Rows with a null id, a null vector, or a null or non-finite component take no part. Rows that repeat another, or just its
    id, count each: as candidates, and as queries, which then have k lines each; a row is no candidate of its own. Vectors
    that are too short end in zeros. Fewer than k candidates give fewer rows; no query or candidate gives none. Other columns
    are ignored.
    """
    vectors = materialize(whole_vectors(rows, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")  # written, so that row stays
    queries = vectors.where(is_query)
    n, m = vectors.count(), queries.count()
    shards = max(1, -(-n // min(SHARD, max(2048, -(-n // 24)))))
    blocks = max(1, -(-m // BLOCK))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")
    trees = materialize(vectors.withColumn("shard", shard).groupBy("shard").applyInArrow(_build, "shard int, tree binary, centre array<double>, radius double"), "trees")
    lowest = F.lit(-(2**63) + 1)
    order = F.pmod(F.col("shard") - F.col("block"), F.lit(shards))  # each block has its own home shard

    def visited(with_kth: DataFrame, a: int, b: int) -> DataFrame:
        """What the shards that come a-th to b-th for a block return to its queries."""
        packed = with_kth.withColumn("block", block).groupBy("block").applyInArrow(_block, "block int, queries binary, at array<double>, reach double, least long")
        packed = materialize(packed, "blocks")
        tiles = packed.drop("queries").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where((order >= a) & (order < b))
        length = lambda v: F.sqrt(_dot(v, v))
        bound = _dot("at", "centre") + length("at") * F.col("radius") + length("centre") * F.col("reach") + F.col("radius") * F.col("reach")
        tiles = tiles.join(trees.select("shard", "centre", "radius"), "shard").where(bound + 1e-6 * (1 + F.abs(bound)) >= F.col("least")).select("block", "shard")
        tiles = materialize(tiles, "tiles")
        left = tiles.join(trees.select("shard", "tree"), "shard").select(F.col("shard").alias("of_shard"), F.col("block").alias("of_block"), "tree")
        right = tiles.join(packed.select("block", "queries"), "block").select(F.col("shard").alias("at_shard"), F.col("block").alias("at_block"), "queries")
        return left.groupBy("of_shard", "of_block").cogroup(right.groupBy("at_shard", "at_block")).applyInArrow(_visit(k), "row long, query_id long, found long, vec_id long, score long")

    a, b = 0, 1
    best = materialize(_best(visited(queries.withColumn("kth", lowest), a, b), k), "best")
    while b < shards:
        a, b = b, min(shards, b * (1 + GROWTH))
        kth = best.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).drop("n")
        bounded = queries.join(kth, "row", "left").select("row", "vec_id", "v", F.coalesce("kth", lowest).alias("kth"))
        best = materialize(_best(best.drop("rank").unionByName(visited(bounded, a, b)), k), "best")
    return best.select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e AS q JOIN e ON q.r <> e.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
