"""Quality classifier from weak labels (operator 9): expectation-maximisation over heuristic labellers, then a hashed
linear scorer trained on the posterior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents
from tidemill.llm.features import QUALITY, quality
from tidemill.llm.textvec import NOT_SPACE, P, Words, mix, ngrams, slices

#: Rows that the linear scorer is fitted on at most: those of the smallest hashes of id and text.
FIT_ROWS = 6000
#: Hashed dimensions.
WIDTH = 4096
#: Bytes of text that a task works on at once: its arrays hold some hundred times that.
SLICE = 1 << 18
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False
#: Documents of at least this probability of low quality are rejected.
REJECT = 0.5
#: (feature, at least words, votes low beyond, votes good within): vote = 2 (low), 1 (good) or 0 (abstains).
LABELLERS = (
    ("symbols", 5, 0.05, 0.01), ("marked_words", 5, 0.2, 0.05), ("capital_words", 10, 0.15, 0.03), ("top_word", 30, 0.2, 0.12), ("distinct_words", 30, -0.4, -0.5),
    ("repeated_words", 20, 0.1, 0.04), ("repeated_lines", 20, 0.35, 0.27), ("mean_word", 10, 7.0, 6.3), ("bare_marks", 10, 0.1, 0.02), ("letters", 5, -0.7, -0.76),
)


def votes(features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(features), len(LABELLERS)), np.int64)
    words = features[:, 0]
    for k, (name, least, low, good) in enumerate(LABELLERS):
        x = features[:, QUALITY.index(name)] * (-1 if low < 0 else 1)  # a negative limit: low values are bad
        out[:, k] = np.where(words < least, 0, np.where(x > low, 2, np.where(x <= good, 1, 0)))
    return out


def _pattern(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def _votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for two classes: (log odds of low, by class-conditional vote tables; the tables).

    Labellers are independent given the class; each has its own table of P(vote | class), so its accuracy and coverage are
    estimated from how it overlaps with the others, without any true label. Abstentions do not count; tables are smoothed by one vote each. The
    start takes any vote of low for a low document; class 1 stays the one with more low votes.
    """
    v = _votes_of(patterns)
    one_hot = (v[:, :, None] == np.arange(3)).astype(float)
    low = np.where((v == 2).any(1), 0.9, 0.1)
    for _ in range(rounds):
        tables, prior = [], []
        for belief in (1 - low, low):
            w = belief * counts
            t = np.einsum("p,plv->lv", w, one_hot) + 1
            t[:, 0] = 0  # an abstention says nothing of the class
            tables.append(np.log(np.maximum(t / t.sum(1, keepdims=True), 1e-300)))
            prior.append(np.log(w.sum() + 1))
        odds = prior[1] - prior[0] + np.einsum("plv,lv->p", one_hot, tables[1] - tables[0])
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - low).max(initial=0) < 1e-9:
            break
        low = new
    return np.concatenate([[prior[1] - prior[0]], (tables[1] - tables[0]).ravel()]), np.stack(tables)


def posterior(v: np.ndarray, model: np.ndarray) -> np.ndarray:
    table = model[1:].reshape(-1, 3)
    odds = model[0] + table[np.arange(v.shape[1]), v].sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _classes() -> np.ndarray:
    c = np.full(256, 31, np.int32)  # other control bytes
    c[0x61:0x7B], c[0x41:0x5B], c[0x30:0x3A], c[0x80:] = 0, 1, 2, 3
    for k, mark in enumerate(" \n.,;:!?'\"()-/|#$%&*_+=@<>"):
        c[ord(mark)] = 4 + k
    return c


CLASSES = _classes()
#: Dimension of each trigram of byte classes.
TRIGRAMS = (mix(np.arange(32768, dtype=np.uint64) * np.uint64(P)) % np.uint64(WIDTH)).astype(np.int32)


def _again(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each value, the binary logarithm of its share of its document's values, downwards from 0."""
    bits = np.uint64(16 if n <= 1 << 16 else int(n - 1).bit_length())
    key = (doc.astype(np.uint64) << (np.uint64(64) - bits)) | (values >> bits)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    runs = np.diff(np.append(np.flatnonzero(new), len(key)))
    count = np.empty(len(key), np.int64)
    count[order] = np.repeat(runs, runs)
    return np.floor(np.log2(np.bincount(doc, minlength=n)[doc] / count)).astype(np.int64)


def hashed(column: pa.Array, once: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, dimension, value) of a text's hashed features, sorted and each pair once if so wanted: frequencies of trigrams of byte
    classes, of words and word pairs, and of words and lines by how much of the text they make up. No vote is among them."""
    whole = Words(column, np.ones(256, bool), fold=False)
    words = Words(column, NOT_SPACE, fold=True)
    lines = Words(column, NOT_NEWLINE, fold=False)
    parts = []

    def dims(kind: int, code: np.ndarray) -> np.ndarray:
        return (mix(code.astype(np.uint64) * np.uint64(P) + np.uint64(kind)) % np.uint64(WIDTH)).astype(np.int64)

    def add(kind: int, code: np.ndarray, doc: np.ndarray, weight: float, size: np.ndarray) -> None:
        parts.append((doc, dims(kind, code), (weight / np.maximum(size, 1))[doc]))

    c, size = CLASSES[whole.data], np.diff(whole.offsets)
    if len(c) > 2:
        at = np.repeat(np.arange(whole.n, dtype=np.int32), size)
        same = at[2:] == at[:-2]
        at = at[2:][same]
        parts.append((at, TRIGRAMS[((c[:-2] * 32 + c[1:-1]) * 32 + c[2:])[same]], (8.0 / np.maximum(size, 1))[at]))
    h, doc = words.hashes(), words.doc()
    add(1, h, doc, 4.0, words.counts)
    if len(h) > 1:
        pair = np.flatnonzero(words.fits(2))
        add(2, ngrams(h, 2)[pair], doc[pair], 4.0, words.counts)
        add(3, (h[pair] == h[pair + 1]), doc[pair], 4.0, words.counts)
    length = np.floor(np.log2(words.counts + 1)).astype(np.int64) // 2
    add(4, _again(h, doc, words.n) * 32 + length[doc], doc, 4.0, words.counts)
    add(5, _again(lines.hashes(), lines.doc(), lines.n) * 32 + np.minimum(np.floor(np.log2(lines.counts + 1)).astype(np.int64), 5)[lines.doc()], lines.doc(), 4.0, lines.counts)
    doc, dim, value = (np.concatenate(x) for x in zip(*parts))
    if not once:
        return doc, dim, value
    key, inverse = np.unique(doc * WIDTH + dim, return_inverse=True)
    return key // WIDTH, key % WIDTH, np.bincount(inverse, value, minlength=len(key))


def _count(batches):
    for batch in batches:
        pattern = [_pattern(votes(quality(batch.column(0).slice(a, b - a)))) for a, b in slices(batch.column(0), SLICE)]
        if pattern:
            kinds, n = np.unique(np.concatenate(pattern), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pattern", "n"])


def _sparse(batches):
    for batch in batches:
        for a, b in slices(batch.column(1), SLICE):
            part = batch.column(1).slice(a, b - a)
            doc, dim, value = hashed(part)
            place = pa.array(np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(place, pa.array(x)) for x in (dim.astype(np.int16), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_pattern(votes(quality(part))).astype(np.int64)), *lists], names=["key", "pattern", "dim", "value"])


#: Features of a block of the fit: its temporary arrays stay small and in the processor's caches.
FIT_BLOCK = 1 << 16


def fit_scorer(doc: np.ndarray, dim: np.ndarray, value: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on probabilities y by Adam, all rows at once; the last weight is the bias. doc is ascending, and
    margins and gradients are summed over blocks of whole documents."""
    place = np.searchsorted(doc, np.arange(len(y) + 1))
    cuts = np.unique(np.append(np.searchsorted(place, np.arange(0, len(doc), FIT_BLOCK)), [0, len(y)]))
    blocks = [(a, b, doc[place[a] : place[b]] - a, slice(place[a], place[b])) for a, b in zip(cuts[:-1], cuts[1:])]
    w, m, s = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for t in range(1, rounds + 1):
        g = 1e-5 * w
        for a, b, of, at in blocks:
            p = 1 / (1 + np.exp(-np.clip(np.bincount(of, value[at] * w[dim[at]], minlength=b - a) + w[-1], -30, 30)))
            e = p - y[a:b]
            g += np.append(np.bincount(dim[at], value[at] * e[of], minlength=WIDTH), e.sum()) / len(y)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def _score(model: np.ndarray, w: np.ndarray):
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                part = batch.column(1).slice(a, b - a)
                v = votes(quality(part))
                doc, dim, value = hashed(part, once=False)
                z = np.bincount(doc, value * w[dim], minlength=len(v)) + w[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(posterior(v, model)), pa.array(p)], names=["key", "posterior", "score"])

    return run


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(label model, linear weights). Vote patterns are counted over all documents (3**10 kinds at most reach the driver);
    the scorer is fitted on FIT_ROWS documents at most, those of the smallest hashes of id and text."""
    text = F.col(text_col).cast("string")
    counted = docs.select(text.alias("text")).mapInArrow(_count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    model, _ = label_model(np.array([r["pattern"] for r in counted], np.int64), np.array([r["n"] for r in counted], float))
    key = F.xxhash64(F.col(id_col).cast("long"), text)
    keys = docs.select(key.alias("key"), text.alias("text"))
    chosen = keys.select("key").orderBy("key").limit(FIT_ROWS).agg(F.max("key")).first()[0]
    if chosen is None:
        return model, np.zeros(WIDTH + 1)
    rows = keys.where(F.col("key") <= F.lit(chosen)).groupBy("key").agg(F.min("text").alias("text"))  # rows that repeat another count once
    sample = rows.mapInArrow(_sparse, "key long, pattern long, dim array<short>, value array<float>").toArrow().sort_by("key")  # sums of floats depend on the order
    dim, value = sample["dim"].combine_chunks(), sample["value"].combine_chunks()
    doc = np.repeat(np.arange(len(sample), dtype=np.int32), dim.value_lengths().to_numpy())
    y = posterior(_votes_of(sample["pattern"].to_numpy()), model)
    w = fit_scorer(doc, dim.flatten().to_numpy(), value.flatten().to_numpy(), y)
    del sample, dim, value
    pa.default_memory_pool().release_unused()  # the driver goes on to other stages
    return model, w


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, posterior, score, keep) for each document: the label model's and the scorer's probability of low quality,
    and whether the latter is below REJECT.

    Labellers judge whole texts by rates of symbols, capitals, repetitions and the like, and abstain on texts too short to
    tell. The scorer sees hashed features of the text alone, none of the votes. Null and empty texts get abstentions only, so
    the prior, and no features, so the bias. Null and repeated ids each get a row, equal texts equal scores; an empty table
    gives none; other columns are ignored.
    """
    model, w = fit_quality(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_score(model, w), "doc_id long, posterior double, score double")
    return scored.withColumn("keep", F.col("score") < REJECT)


def _kept(model: np.ndarray, w: np.ndarray):
    score = _score(model, w)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            p = [r.column(2).to_numpy() for r in score([pa.RecordBatch.from_arrays([column, column], names=["key", "text"])])]
            yield batch.filter(pa.array(np.concatenate(p) < REJECT)) if p else batch

    return run


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that score_quality() keeps, with all their columns."""
    model, w = fit_quality(docs)
    return docs.mapInArrow(_kept(model, w), docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir))
