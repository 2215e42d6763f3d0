"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all training windows (operator 3)."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents, materialize
from tidemill.llm.textvec import ALNUM, Words, ngrams, per_document, slices

WIDTH = 10
#: Bytes of benchmark text whose windows one broadcast holds, as a table of about seven times that; a larger benchmark is
#: scanned for in several rounds.
BROADCAST_BYTES = 4 << 20
#: Words of a benchmark item that are taken as one; the parts of a longer one overlap by a window less a word.
ITEM_WORDS = 1 << 16
#: Items of documents that are given out at once.
ITEMS = 1 << 20


class Windows:
    """The distinct windows of some benchmark items: sorted hashes by length, and for each where its words are and which items
    have it (items[at[w]:at[w + 1]], distinct), as arrays."""

    def __init__(self, items: pa.Array, texts: pa.Array, width: int):
        words = Words(texts, ALNUM, fold=True)
        self.text, place = words.spelled()
        named, hashes, self.tables = items.is_valid().to_numpy(zero_copy_only=False), words.hashes(), {}
        ids = items.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        doc, length = words.doc(), words.end - words.start
        for k in sorted({min(width, n) for n in words.counts.tolist()} - {0}):
            whole = np.repeat((words.counts == k) | ((k == width) & (words.counts > width)), words.counts)
            at = np.flatnonzero(words.fits(k) & whole)
            h = ngrams(hashes, k)[at]
            order = np.argsort(h, kind="stable")
            at, h = at[order], h[order]
            start, end = place[at], place[at + k - 1] + length[at + k - 1]
            window = self._distinct(h, start, end)
            one = np.unique(window, return_index=True)[1]
            pairs = np.unique(np.stack([window, ids[doc[at]]])[:, named[doc[at]]], axis=1)
            self.tables[k] = (h[one], start[one], end[one], np.searchsorted(pairs[0], np.arange(len(one) + 1)), pairs[1])

    def _distinct(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number for each window, the same for those of the same words; it does not fall where hashes rise."""
        fresh = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        seen: dict[bytes, int] = {}
        number, out = -1, np.empty(len(h), np.int64)
        for j, new in enumerate(fresh.tolist()):
            if new:
                seen = {}
            spelled = self.text[start[j] : end[j]]
            if spelled not in seen:
                number += 1
                seen[spelled] = number
            out[j] = seen[spelled]
        return out

    def hits(self, words: Words, hashes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Verified occurrences in some texts: (text, first word, words, window). Each is compared with the window of its hash, of
        which there is one but for clashes."""
        out, doc = [], words.doc()
        for k, (keys, start, end, _, _) in self.tables.items():
            grams = ngrams(hashes, k)
            lo = np.searchsorted(keys, grams)
            for i in np.flatnonzero((keys[np.minimum(lo, len(keys) - 1)] == grams) & words.fits(k)[: len(grams)]).tolist():
                seen, j = words.bytes(i, i + k), int(lo[i])
                while j < len(keys) and keys[j] == grams[i]:
                    if self.text[start[j] : end[j]] == seen:
                        out.append((int(doc[i]), i, k, j))
                        break
                    j += 1
        return out

    def items(self, windows: frozenset) -> np.ndarray:
        """The items that have some of the windows (words, window), in order."""
        some = [self.tables[k][4][self.tables[k][3][w] : self.tables[k][3][w + 1]] for k, w in windows]
        return some[0] if len(some) == 1 else np.unique(np.concatenate(some)) if some else np.zeros(0, np.int64)


def _scan(windows: Windows):
    def run(column):
        words = Words(column, ALNUM, fold=True)
        return words, windows.hits(words, words.hashes())

    return run


def _report(windows: Windows):
    scan = _scan(windows)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                words, hits = scan(batch.column(1).slice(a, b - a))
                cover, held = np.zeros(len(words.start) + 1, np.int64), defaultdict(set)
                for d, i, k, w in hits:
                    cover[i] += 1
                    cover[i + k] -= 1
                    held[d].add((k, w))
                inside = np.cumsum(cover)[:-1] > 0
                hit = per_document(inside, words.at)
                runs = [[] for _ in range(words.n)]
                for d in np.flatnonzero(hit).tolist():
                    w = np.arange(words.at[d], words.at[d + 1])[inside[words.at[d] : words.at[d + 1]]]
                    for r in np.split(w, np.flatnonzero(np.diff(w) > 1) + 1):
                        place = (r[0] - words.at[d], r[-1] + 1 - words.at[d], words.start[r[0]] - words.offsets[d], words.end[r[-1]] - words.offsets[d])
                        runs[d].append(dict(zip(("first", "last", "start", "end"), map(int, place))))
                known, items = {}, []  # documents often hold the same windows
                for d in range(words.n):
                    key = frozenset(held.get(d, ()))
                    if key not in known:
                        known[key] = windows.items(key)
                    items.append(known[key])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in items])])
                c = 0
                while c < words.n:  # many items that share a window make long rows: some at a time
                    e = max(int(np.searchsorted(ends, ends[c] + ITEMS, "right")) - 1, c + 1)
                    lists = pa.ListArray.from_arrays(pa.array((ends[c : e + 1] - ends[c]).astype(np.int32)), pa.array(np.concatenate(items[c:e]), pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(a + c, e - c),
                            pa.array(words.counts[c:e].astype(np.int64)),
                            pa.array(hit[c:e]),
                            lists,
                            pa.array(runs[c:e], pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))),
                        ],
                        names=["row", "n_words", "n_hit", "items", "runs"],
                    )
                    c = e

    return run


def _parts(width: int):
    """Items of over ITEM_WORDS words in parts that hold all their windows; null texts are left out."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                words, items, texts = Words(batch.column(1).slice(a, b - a), ALNUM, fold=True), [], []
                for d, item in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    first, last = int(words.at[d]), int(words.at[d + 1])
                    for i in range(first, max(last - width + 1, first + 1) if last > first else first, ITEM_WORDS):
                        items.append(item)
                        texts.append(words.bytes(i, min(i + ITEM_WORDS + width - 1, last)))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["item", "text"])

    return run


def _build(width: int):
    def run(table):
        windows = Windows(table["item"].combine_chunks(), table["text"].combine_chunks(), width)
        return pa.table({"shard": table["shard"].slice(0, 1), "windows": pa.array([pickle.dumps((windows.text, windows.tables))], pa.binary())})

    return run


def _shards(bench: DataFrame, width: int, item_col: str, text_col: str) -> Iterator[tuple[Windows, int]]:
    """The benchmark's windows, BROADCAST_BYTES of text at a time, and the number of such shards. Executors build them; the driver holds one at a time."""
    items = bench.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    parts = materialize(items.mapInArrow(_parts(width), "item long, text string").distinct(), "items")
    size = parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(-(-size // BROADCAST_BYTES)) or 1
    shard = F.pmod(F.xxhash64("item", "text"), F.lit(count)).cast("int").alias("shard")
    built = materialize(parts.select(shard, "item", "text").groupBy("shard").applyInArrow(_build(width), "shard int, windows binary"), "windows")
    for k in range(count):
        windows, found = Windows.__new__(Windows), built.where(F.col("shard") == k).first()
        windows.text, windows.tables = pickle.loads(found["windows"]) if found else (b"", {})
        yield windows, count


def benchmark_hits(docs: DataFrame, bench: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, items, runs) for each document: hit words, items with occurring windows, and the runs of
    hit words as word ranges [first, last) and byte ranges [start, end).

    Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. A window is width consecutive item
    words, or a shorter item as a whole; a document word inside any occurrence is hit. Only the benchmark is broadcast,
    BROADCAST_BYTES of its text at a time, as tables that executors build; documents are scanned where they are read, without
    a shuffle. A larger benchmark takes one scan a shard, and the shards' hits meet by row; their runs may then overlap.

    Null texts have no words; an item with a null id marks words but is no item; repeated items count once, repeated
    documents each get a row; an empty benchmark hits nothing; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "row long, n_words long, n_hit long, items array<long>, runs array<struct<first:long,last:long,start:long,end:long>>"
    found = None
    for windows, count in _shards(bench, width, item_col, text_col):
        if count == 1:
            return rows.select("doc_id", "text").mapInArrow(_report(windows), schema).withColumnRenamed("row", "doc_id")
        if found is None:  # the first round's report has all rows, with their words
            rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
            found = materialize(rows.select("row", "text").mapInArrow(_report(windows), schema), "hits")
        else:
            found = found.unionByName(materialize(rows.select("row", "text").mapInArrow(_report(windows), schema).where("n_hit > 0"), "hits"))
    runs = F.array_sort(F.flatten(F.collect_list("runs")))  # as many as the shards and the text's hits
    merged = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), runs.alias("runs"))
    n_hit = F.expr("aggregate(runs, struct(0L AS n, 0L AS reach), (a, r) -> struct(a.n + greatest(0L, r.last - greatest(r.first, a.reach)) AS n, greatest(a.reach, r.last) AS reach), a -> a.n)")
    return rows.select("row", "doc_id").join(merged, "row").select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "runs")


def _without(windows: Windows):
    scan = _scan(windows)

    def run(batches):
        for batch in batches:
            column, dirty = batch.column(batch.schema.get_field_index("text")), set()
            for a, b in slices(column):
                dirty.update(a + h[0] for h in scan(column.slice(a, b - a))[1])
            yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in dirty], pa.int64())) if dirty else batch

    return run


def drop_contaminated(docs: DataFrame, bench: DataFrame, width: int = WIDTH, item_col: str = "item_id") -> DataFrame:
    """The documents without any occurrence of a window, all their columns unchanged, without a shuffle: in one pass, or one
    a round of a larger benchmark. Cases as in benchmark_hits(); null texts stay."""
    for windows, count in _shards(bench, width, item_col, "text"):
        docs = docs.mapInArrow(_without(windows), docs.schema)
        if count > 1:
            docs = materialize(docs, "clean")
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT DISTINCT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
