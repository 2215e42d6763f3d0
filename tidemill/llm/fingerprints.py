"""Document fingerprints: weighted SimHash, and all fingerprints within a Hamming radius by permuted block tables (operator 11)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemill.llm.common import documents, heavy_split_join, input_columns, materialize
from tidemill.llm.textvec import NOT_SPACE, P, Words, mix, ngrams, slices

#: Bits of a fingerprint, and bytes.
BITS, BYTES = 256, 32
#: Fingerprints that differ in RADIUS bits at most agree on one of RADIUS + 1 blocks.
RADIUS = 7
#: Fingerprints of a block table's cell that are compared in one piece, and those of a task's cells together.
TILE, GROUP, SIDE = 4096, 1 << 15, 512
#: Votes of each byte value for its eight bits.
VOTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="big").astype(np.float64) * 2 - 1


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, 64-bit hash) of each term of each text. A term is two neighbouring words (runs without ASCII white space, A-Z in
    lower case); a text of one word has that word."""
    words = Words(column, NOT_SPACE, fold=True)
    doc, hashes = words.doc(), words.hashes()
    alone = np.flatnonzero(words.counts[doc] == 1) if len(doc) else doc
    pair = np.flatnonzero(words.fits(2))
    return np.concatenate([doc[pair], doc[alone]]), np.concatenate([ngrams(hashes, 2)[pair], hashes[alone]]), words.n


def simhash(column: pa.Array) -> np.ndarray:
    """The fingerprints of some texts, BYTES bytes each. Each distinct term votes with weight 1 + floor(log2(times)) for each
    bit of its hash, for 1 or for 0; a bit is 1 if more votes are for it. Weights are whole numbers, so that a text's
    fingerprint does not depend on the texts around it. No words: all bits are 0."""
    doc, hashes, n = terms(column)
    votes = np.zeros((n, BITS))
    if len(doc):
        order = np.lexsort((hashes, doc))
        doc, hashes = doc[order], hashes[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]))
        weight = np.frexp(np.diff(np.append(first, len(doc))).astype(float))[1].astype(float)  # 1 + floor(log2)
        doc, hashes = doc[first], hashes[first]
        for word in range(BITS // 64):
            spelled = mix(hashes + np.uint64((P * (word + 1)) & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
            for b in range(8):
                cells = np.bincount(doc * 256 + spelled[:, b], weight, n * 256).reshape(n, 256)
                votes[:, (word * 8 + b) * 8 : (word * 8 + b) * 8 + 8] = cells @ VOTES
    return np.packbits(votes > 0, axis=1, bitorder="big")


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of bits that agree."""
    return 1 - np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) / BITS


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the start of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


MARKS = "part long, edge int, doc_id long, text string, fp binary, n_chars long, edited_sha256 string, edited_fp binary, near_edited double, near_next double"
_ARROW = pa.schema([
    ("part", pa.int64()), ("edge", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("fp", pa.binary()), ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()), ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
DOC, FIRST, LAST = 0, 1, 2


def _marked(part: int | None, ids: list, texts: list[str], fp: np.ndarray, following: list[str], next_fp: np.ndarray) -> pa.RecordBatch:
    """Finished rows of texts whose following texts are known."""
    new = [edited(t, f) for t, f in zip(texts, following)]
    again = simhash(pa.array(new, pa.large_string()))
    n, blobs = len(texts), lambda f: pa.array([r.tobytes() for r in f], pa.binary())
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in new]
    return pa.RecordBatch.from_arrays([
        pa.array([part] * n, pa.int64()), pa.array([DOC] * n, pa.int32()), pa.array(ids, pa.int64()), pa.nulls(n, pa.string()), blobs(fp), pa.array([len(t) for t in texts], pa.int64()),
        pa.array(sha, pa.string()), blobs(again), pa.array(likeness(fp, again)), pa.array(likeness(fp, next_fp)),
    ], schema=_ARROW)


def _edge(part: int, edge: int, doc_id: int | None, text: str, fp: np.ndarray) -> pa.RecordBatch:
    row = dict.fromkeys(_ARROW.names) | {"part": part, "edge": edge, "doc_id": doc_id, "text": text, "fp": fp.tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def _sorted_part(batches):
    """Fingerprints of a range of documents in order. Each text is edited with the one after it; the range's first and last
    text are given out for the ranges around."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        for a, b in slices(batch.column(1)):
            column = batch.column(1).slice(a, b - a)
            ids, texts, fp = batch.column(0).slice(a, b - a).to_pylist(), column.to_pylist(), simhash(column)
            if held is None:
                yield _edge(part, FIRST, ids[0], texts[0], fp[0])
            else:
                ids, texts, fp = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], fp])
            if len(ids) > 1:
                yield _marked(part, ids[:-1], texts[:-1], fp[:-1], texts[1:], fp[1:])
            held = ids[-1], texts[-1], fp[-1]
    if held is not None:
        yield _edge(part, LAST, *held)


def _sorted_edges(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            doc_id, text, fp, following, next_fp = (c[k].as_py() for c in batch.columns)
            fp, next_fp = (np.frombuffer(f, np.uint8)[None] for f in (fp, next_fp))
            yield _marked(None, [doc_id], [text], fp, [following], next_fp)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) of each document: its fingerprint, and that of
    the text edited with the next document in descending order of id (after the last one comes the first).

    Documents are dealt into ranges, within which each meets the next one; the ranges' edges, two texts a range, meet by a
    join. Rows of one id are in order of their text's hash, and a crowd of them is dealt over ranges as well. Null texts are
    empty; null ids come last; other columns are ignored. No documents: no rows.
    """
    rows = input_columns(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_k"))
    order = [F.col("doc_id").desc_nulls_last(), "_h", "_k"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    marks = materialize(ranged.mapInArrow(_sorted_part, MARKS), "marks")
    ends = marks.where(F.col("edge") == LAST).select("part", "doc_id", "text", "fp")
    starts = marks.where(F.col("edge") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fp").alias("next_fp"))
    around = W.orderBy("part")  # a row a range
    after = marks.where(F.col("edge") == FIRST).select("part", F.lead("part").over(around).alias("_n"), F.min("part").over(W.partitionBy()).alias("_f"))
    met = ends.join(after.select("part", F.coalesce("_n", "_f").alias("next")), "part").join(starts, "next")
    last = met.select("doc_id", "text", "fp", "following", "next_fp").mapInArrow(_sorted_edges, MARKS)
    keep = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]
    return marks.where(F.col("edge") == DOC).select(keep).unionByName(last.select(keep))


def _cells(table: pa.Table) -> pa.Table:
    """(fp, near): for each fingerprint of some cells the documents of those within RADIUS of it; a pair counts in the first
    table whose block it agrees on."""
    fp = np.frombuffer(b"".join(table["fp"].to_pylist()), np.uint8).reshape(-1, BYTES)
    which, n, part = table["block"].to_numpy(), table["n"].to_numpy(), table["part"].to_numpy()
    keys = [which, fp[np.arange(len(fp))[:, None], which[:, None] * 4 + np.arange(4)].copy().view(np.uint32).ravel(), table["tile_a"].to_numpy(), table["tile_b"].to_numpy()]
    order = np.lexsort((part, *keys[::-1]))
    fp, which, n, part, keys = fp[order], which[order], n[order], part[order], [k[order] for k in keys]
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    at, near = np.append(np.flatnonzero(new), len(fp)), np.zeros(len(fp), np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        middle = a + int(np.searchsorted(part[a:b], keys[3][a])) if keys[2][a] != keys[3][a] else None  # one part against the other, or all
        for i in range(a, b if middle is None else middle, SIDE):
            i1 = min(i + SIDE, b if middle is None else middle)
            for j in range(i if middle is None else middle, b, SIDE):
                j1 = min(j + SIDE, b)
                differ = fp[i:i1, None] ^ fp[None, j:j1]
                ok = np.bitwise_count(differ.view(np.uint64)).sum(axis=2, dtype=np.uint16) <= RADIUS
                ok &= (differ.view(np.uint32)[:, :, : which[a]] != 0).all(axis=2)
                if middle is None and i == j:
                    ok = np.triu(ok, 1)
                near[i:i1] += ok @ n[j:j1]
                near[j:j1] += n[i:i1] @ ok
    some = np.flatnonzero(near)
    return pa.table({"fp": pa.array([fp[i].tobytes() for i in some], pa.binary()), "near": near[some]})


def near_counts(marks: DataFrame) -> DataFrame:
    """(fp, n, n_near) of marks (fp): the documents of each fingerprint, and those of other fingerprints within RADIUS.

    Exact: a table for each of RADIUS + 1 blocks is grouped by that block, and pairs are compared within its cells only.
    Equal fingerprints are one row. Cells of one fingerprint are left out before they are moved; one of over TILE is dealt
    into tiles, part against part, so that no task has it whole. Only sums leave a cell, however many pairs it has.
    """
    own = materialize(marks.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(RADIUS))).alias("block")
    size = BYTES // (RADIUS + 1)
    placed = own.select("fp", "n", blocks).withColumn("key", F.expr(f"substring(fp, block * {size} + 1, {size})"))
    shared = placed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.when(F.col("size") > TILE, F.ceil(F.col("size") / F.lit(TILE // 2))).otherwise(1).cast("int")
    shared = materialize(shared.select("block", "key", parts.alias("parts")), "shared")
    dealt = placed.join(shared, ["block", "key"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = dealt.select("fp", "n", "block", "key", "part", F.least("part", "other").alias("tile_a"), F.greatest("part", "other").alias("tile_b"))
    groups = (shared.agg(F.sum(F.col("parts") * F.col("parts"))).first()[0] or 0) * TILE // GROUP + 1
    group = F.pmod(F.xxhash64("block", "key", "tile_a", "tile_b"), F.lit(groups))
    near = tiles.withColumn("group", group).drop("key").groupBy("group").applyInArrow(_cells, "fp binary, near long")
    sums = near.groupBy("fp").agg(F.sum("near").alias("near"))
    return own.join(sums, "fp", "left").select("fp", "n", F.coalesce("near", F.lit(0)).alias("n_near"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns n_near, the other documents whose fingerprint is within RADIUS bits."""
    marks = materialize(fingerprint_documents(documents(spark, sf_dir)), "fingerprinted")
    counts = materialize(near_counts(marks), "near")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = heavy_split_join(marks, counts.select("fp", (F.col("n") - 1 + F.col("n_near")).alias("n_near")), "fp", counts.select("fp", "n"), total)
    name = lambda c: F.lower(F.hex(c))
    return found.select("doc_id", "n_chars", "edited_sha256", name("fp").alias("fingerprint"), name("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
