"""SimHash near-duplicates through vantage-point trees over fingerprints (operator 4)."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemill.llm.common import documents, heavy_split_join, materialize
from tidemill.llm.graph import Forest, components
from tidemill.llm.textvec import NOT_SPACE, Words, slices

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Fingerprints of a tree's leaf, those above which a cell is dealt into shards, and those of a task's cells together.
LEAF, TILE, GROUP = 64, 4096, 1 << 15
#: Fingerprints compared at once within a task: BLOCK x BLOCK distances.
BLOCK = 1024


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: a bit is 1 if over half the hashes of its word shingles have it; 0 without words."""
    words = Words(column, NOT_SPACE, fold=True)
    out = np.zeros(words.n, np.uint64)
    if not len(words.start):
        return out
    joined, place = words.spelled()
    last = np.minimum(np.arange(len(words.start)) + shingle, np.repeat(words.at[1:], words.counts))  # past a shingle's words
    short = np.repeat(words.counts < shingle, words.counts)
    first = np.zeros(len(words.start), bool)
    first[words.at[:-1][words.counts > 0]] = True
    use = np.flatnonzero(words.fits(shingle) | (short & first))
    digest = xxhash.xxh64_intdigest
    a, b = place[use].tolist(), (place[last[use]] - 1).tolist()
    at = np.searchsorted(use, words.at)
    full = np.flatnonzero(np.diff(at))
    for d0 in range(0, len(full), 512):
        group = full[d0 : d0 + 512]
        lo, hi = int(at[group[0]]), int(at[group[-1] + 1])
        total = np.zeros((len(group), 64), np.int64)
        n = at[group + 1] - at[group]
        of = np.repeat(np.arange(len(group)), n)
        for c in range(lo, hi, 1 << 16):  # a very long text in parts
            e = min(c + (1 << 16), hi)
            h = np.array([digest(joined[x:y], SEED) for x, y in zip(a[c:e], b[c:e])], np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            docs, starts = np.unique(of[c - lo : e - lo], return_index=True)
            total[docs] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[group] = np.packbits(total * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def _fingerprint(shingle: int):
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                fp = fingerprints(batch.column(1).slice(a, b - a), shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def block_masks(n: int, distance: int = DISTANCE, blocks: int | None = None) -> list[int]:
    """Masks of bits, of which any two fingerprints within `distance` agree on all bits of one at least.

    The 64 bits are cut into blocks; a mask is a choice of all but `distance` of them, as that many blocks can differ. There
    are as few masks as keep cells of random fingerprints at a few thousand. No more blocks than distance: one empty mask.
    """
    if blocks is None:
        blocks = next(b for b in range(distance + 1, distance + 6) if b == distance + 5 or n / 2 ** (64 * (b - distance) / b) <= TILE)
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    parts = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(parts, max(blocks - distance, 0))]


class VantageTree:
    """Links within `distance` among some fingerprints, by a vantage-point tree over them.

    A node's vantage point is one of its fingerprints. The median distance from it is the node's radius: those within make
    one branch, those beyond the other. By the triangle inequality two fingerprints can be within `distance` of each other
    only if their distances from the vantage point differ by no more, so across the radius each ring is compared only with
    the rings that near, and all else between the branches is pruned. All within `distance` of the vantage point are linked
    to it, and branches that are linked as a whole are compared no further: only components matter. `compared` counts the
    distances taken.
    """

    def __init__(self, fp: np.ndarray, distance: int, home: np.ndarray | None = None, side: np.ndarray | None = None):
        self.fp, self.distance, self.home, self.side = fp, distance, home, side
        self.forest, self.compared = Forest(len(fp)), 0

    def link(self) -> Forest:
        stack = [np.arange(len(self.fp))]
        while stack:
            node = stack.pop()
            if len(node) <= LEAF:
                self._compare(node, node)
                continue
            far = np.bitwise_count(self.fp[node] ^ self.fp[node[0]]).astype(np.int64)
            self.compared += len(node)
            near = node[far <= self.distance]
            self.forest.link(np.full(len(near), node[0]), near)
            if far.max() <= self.distance:
                continue
            radius = int(np.partition(far, len(far) // 2)[len(far) // 2])
            radius = radius if radius < far.max() else radius - 1
            inner, outer = node[far <= radius], node[far > radius]
            if min(len(inner), len(outer)) * 16 < len(node):  # nearly all in one ring: the tree would be a list
                self._compare(node, node)
                continue
            stack += [inner, outer]
            for ring in range(radius + 1, radius + self.distance + 1):
                self._compare(node[(far <= radius) & (far >= ring - self.distance)], node[far == ring])
        return self.forest

    def _compare(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.forest.root
        if not len(a) or not len(b) or (root[a] == root[a[0]]).all() and (root[b] == root[a[0]]).all():
            return
        for i in range(0, len(a), BLOCK):
            for j in range(i if a is b else 0, len(b), BLOCK):
                x, y = a[i : i + BLOCK], b[j : j + BLOCK]
                near = np.bitwise_count(self.fp[x, None] ^ self.fp[None, y]) <= self.distance
                self.compared += near.size if a is not b or i != j else len(x) * (len(x) - 1) // 2
                p, q = np.nonzero(near)
                p, q = x[p], y[q]
                keep = p != q
                if self.home is not None:
                    keep &= self.home[p] | self.home[q]
                if self.side is not None:
                    keep &= self.side[p] != self.side[q]
                self.forest.link(p[keep], q[keep])


def _pairs(distance: int):
    """Spanning forests of the links in each cell of a group of cells."""

    def run(table):
        fp, first = table["fp"].to_numpy().view(np.uint64), table["first"].fill_null(np.iinfo(np.int64).max).to_numpy()
        keys = [table[c].to_numpy() for c in ("mask", "key", "band", "tile_a", "tile_b")]
        order = np.lexsort((fp, first, *keys[::-1]))  # a forest's roots are then the smallest documents
        fp, first, keys = fp[order], first[order], [k[order] for k in keys]
        home, part = table["home"].to_numpy()[order], table["part"].to_numpy()[order]
        new = np.ones(len(fp), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        at = np.append(np.flatnonzero(new), len(fp))
        low, high = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a > 1:
                across = keys[3][a] != keys[4][a]  # each part alone is another tile's
                x, y = VantageTree(fp[a:b], distance, home[a:b] if not home[a:b].all() else None, part[a:b] if across else None).link().links()
                low.append(x + a)
                high.append(y + a)
        low, high = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (low, high))
        names = ["low_first", "low_fp", "high_first", "high_fp"]
        return pa.Table.from_arrays([pa.array(x) for x in (first[low], fp[low].view(np.int64), first[high], fp[high].view(np.int64))], names=names)

    return run


def _bands(crowded: DataFrame, distance: int) -> DataFrame:
    """crowded (mask, key, fp, first, point) dealt into shards (band, tile) of the cell's vantage point, point.

    A band is a range of distances from that point with some TILE fingerprints, or one distance. By the triangle bound a link
    joins distances that differ by `distance` at most, so each band also gets the rows of lower bands that lie so near to its
    lower boundary; they are not at home there. A band that is crowded all the same is dealt into tiles, part against part.
    """
    cell = ["mask", "key"]
    crowded = crowded.withColumn("far", F.bit_count(F.col("fp").bitwiseXOR(F.col("point"))))
    rings = crowded.groupBy(*cell, "far").agg(F.count(F.lit(1)).alias("c"))  # 65 a cell at most
    before = F.sum("c").over(W.partitionBy(*cell).orderBy("far")) - F.col("c")
    rings = materialize(rings.select(*cell, "far", "c", F.floor(before / TILE).cast("int").alias("own")), "rings")
    bands = rings.groupBy(*cell, F.col("own").alias("band")).agg(F.min("far").alias("edge"))
    reach = rings.join(bands, cell).where((F.col("band") == F.col("own")) | (F.col("band") > F.col("own")) & (F.col("edge") - F.col("far") <= distance))
    reach = materialize(reach.select(*cell, "far", "c", "band", (F.col("band") == F.col("own")).alias("home")), "reach")
    size = reach.groupBy(*cell, "band").agg(F.sum("c").alias("n"))
    parts = F.when(F.col("n") > 2 * TILE, F.ceil(F.col("n") / F.lit(TILE // 2))).otherwise(F.lit(1)).cast("int")
    dealt = crowded.join(reach.drop("c"), [*cell, "far"]).join(size.select(*cell, "band", parts.alias("parts")), [*cell, "band"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(*cell, "band", F.least("part", "other").alias("tile_a"), F.greatest("part", "other").alias("tile_b"), "part", "home", "fp", "first")


def near_links(cells: DataFrame, n: int, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """Links (low, high) between distinct fingerprints of cells (fp, first): a spanning forest of all pairs within `distance`
    in each cell, so no link between components is lost and no group is expanded into all its pairs.

    Random fingerprints lie 32 +- 4 bits from any vantage point, where a triangle bound of 4 prunes about half of a branch at
    most: that alone would not do for very many. So fingerprints are first dealt into the cells of block_masks(), a row for
    each mask, and each cell has its own vantage-point tree. A cell of over TILE fingerprints (a crowd of near copies) is
    dealt into shards by distance from a vantage point of its own, with boundary rows in all shards that they overlap.
    """
    masks = block_masks(n, distance, blocks)
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    choices = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(signed(m)).alias("key")) for i, m in enumerate(masks)])
    placed = cells.select("fp", "first", F.explode(choices).alias("at")).select("at.mask", "at.key", "fp", "first")
    crowd = placed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("point")).where(F.col("n") > TILE)
    crowd = materialize(crowd.select("mask", "key", "point"), "crowd")
    zero = [F.lit(0).alias(c) for c in ("band", "tile_a", "tile_b", "part")]
    dealt = placed.join(crowd, ["mask", "key"], "left_anti").select("mask", "key", *zero, F.lit(True).alias("home"), "fp", "first")
    if not crowd.isEmpty():
        dealt = dealt.unionByName(_bands(placed.join(crowd, ["mask", "key"]), distance))
    group = F.pmod(F.xxhash64("mask", "key", "band", "tile_a", "tile_b"), F.lit(n * len(masks) // GROUP + 1))
    found = dealt.withColumn("group", group).groupBy("group").applyInArrow(_pairs(distance), "low_first long, low_fp long, high_first long, high_fp long")
    node = lambda x: F.struct(F.col(f"{x}_first").alias("first"), F.col(f"{x}_fp").alias("fp"))
    return found.select(node("low").alias("low"), node("high").alias("high"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each document: its 64-bit SimHash and the smallest doc_id linked to it, directly or
    through others, by fingerprints that differ in `distance` bits at most. Exact, not approximate.

    Words are lower-cased (A-Z) runs without ASCII white space; null and empty texts have none and fingerprint 0. Equal
    fingerprints are aggregated to one node first, so a crowd of exact copies is one row from there on. Null ids are
    linked like others and are never the smallest; repeated rows each get a row; an empty table gives none; other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = materialize(rows.mapInArrow(_fingerprint(shingle), "doc_id long, fp long"), "fingerprints")
    cells = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "cells")
    return labelled(marks, cells, near_links(cells, cells.count(), distance, blocks))


def labelled(marks: DataFrame, cells: DataFrame, links: DataFrame) -> DataFrame:
    """marks (doc_id, fp) with component_id, by links between the nodes of cells (fp, first, n)."""
    total = cells.agg(F.sum("n")).first()[0]
    roots = components(links).select(F.col("node.fp").alias("fp"), F.col("root.first").alias("root"))
    nobody = F.lit(2**63 - 1)
    grouped = cells.select("fp", "first", "n").join(roots, "fp", "left").where("root IS NOT NULL OR n > 1")
    table = materialize(grouped.select("fp", F.nullif(F.coalesce("root", "first"), nobody).alias("component_id")), "components")
    joined = heavy_split_join(marks, table, "fp", cells.select("fp", "n"), total or 0)
    return joined.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each group, the one of the smallest doc_id, with all columns. Rows with one doc_id count as one
    document, of which one row stays; rows without an id have none to be judged by and stay. Other cases as above."""
    return keep_first(docs, simhash_components(docs, shingle, distance))


def keep_first(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs without those that marked (doc_id, component_id) gives another document's component."""
    marked = materialize(marked.select("doc_id", "component_id"), "marked")
    gone = marked.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"), F.count(F.lit(1)).alias("n"))
    gone = materialize(gone.where("doc_id IS NOT NULL AND (stays = 0 OR n > 1)"), "gone")
    kept = docs.join(gone.where("stays = 0").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    repeated = gone.where("stays = 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(again.select(docs.columns))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
