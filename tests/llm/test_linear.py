"""Windows that very many items share: time in proportion to hits, results as by brute force."""

import hashlib
import time

import numpy as np
import pyarrow as pa

from tidemill.llm import decontamination


def test_many_items_of_one_window(spark, monkeypatch):
    """Items that all start with one window, quoted by many documents; some documents hold what is special to an item as well."""
    head = "please answer the question that follows as briefly as you can"  # eleven words: two windows
    bench = [(i, f"{head} q{i} r{i} s{i}") for i in range(3000)] + [(None, f"{head} nobody"), (5000, head), (5000, head)]
    docs = [(d, f"see {head} or not") for d in range(2000)] + [(9000, f"x {head} q7 y"), (9001, "nothing here")]
    tables = [spark.createDataFrame(rows, schema).repartition(4) for rows, schema in ((docs, "doc_id long, text string"), (bench, "item_id long, text string"))]
    start = time.time()
    rows = {r.doc_id: r for r in decontamination.benchmark_hits(*tables).selectExpr("doc_id", "n_hit", "size(items) AS n", "sha2(array_join(items, ','), 256) AS sha").collect()}
    assert time.time() - start < 60
    everyone = hashlib.sha256(",".join(map(str, [*range(3000), 5000])).encode()).hexdigest()
    assert len(rows) == 2002 and all((rows[d].n_hit, rows[d].n, rows[d].sha) == (11, 3001, everyone) for d in range(2000))
    assert (rows[9000].n_hit, rows[9000].n, rows[9001].n_hit, rows[9001].n) == (12, 3001, 0, 0)


def test_windows_of_one_hash(monkeypatch):
    """Windows whose hashes clash are told apart by their words, in the benchmark and in texts."""
    monkeypatch.setattr(decontamination, "ngrams", lambda words, k: np.full(max(len(words) - k + 1, 0), 7, np.uint64))
    windows = decontamination.Windows(pa.array([1, 2, 3, None]), pa.array(["a b", "c d", "a b", "e f"]), 2)
    words = decontamination.Words(pa.array(["a b c", "e f", "x y c d"]), decontamination.ALNUM, True)
    found = [(d, i, windows.items(frozenset([(k, w)])).tolist()) for d, i, k, w in windows.hits(words, words.hashes())]
    assert found == [(0, 0, [1, 3]), (1, 3, []), (2, 7, [2])]
