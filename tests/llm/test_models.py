"""Features, labellers, expectation-maximisation, trees and calibration of operators 9 and 10 against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from conftest import ODD
from oracle import SF
from tidemill.llm import features, quality, tokens, toxicity
from tidemill.llm.textvec import ALNUM, Words

TEXTS = [t for _, t in ODD if t is not None and len(t) < 10_000] + [
    "You are such a st0pid IDIOT, you!! #@$", "line one\nline one\nline two\n\nline one", "A B c d " * 20, "x", "... --- ...", "tr@sh trash TRASH you", "ÄÖÜ ist nicht 42 \x1c dumm", "aaaa bbbb aaaa aaaa", "",
]
LETTER, SPACE = "[A-Za-z\x80-\xff]", "[^\x20\x09-\x0d]+"


def latin(text):
    """One character a byte, so that patterns see bytes."""
    return text.encode().decode("latin-1")


def fold(word):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in word)


def share(text, chars):
    return sum(c in chars for c in text) / max(len(text), 1)


SYMBOL, MARK = "#$%&*+<=>@[\\]^_`{|}~", "!?.,;:"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def slow_quality(text):
    t = latin(text)
    w = re.findall(SPACE, t)
    low, n = [fold(x) for x in w], max(len(w), 1)
    lines = re.findall("[^\n]+", t)
    letters, upper = ([len(re.findall(p, x)) for x in w] for p in (LETTER, "[A-Z]"))
    return [
        len(w), share(t, SYMBOL), sum(any(c in SYMBOL for c in x) for x in w) / n, sum(u >= 2 and u == k for u, k in zip(upper, letters)) / n, max(Counter(low).values(), default=0) / n, len(set(low)) / n,
        sum(a == b for a, b in zip(low, low[1:])) / n, 1 - len(set(lines)) / len(lines) if lines else 0.0, share(t, "0123456789"), sum(map(len, w)) / n, sum(not re.search("[0-9A-Za-z\x80-\xff]", x) for x in w) / n, len(re.findall(LETTER, t)) / max(len(t), 1),
    ]


def test_quality_features_and_votes():
    got = features.quality(pa.array(TEXTS))
    assert np.allclose(got, [slow_quality(t) for t in TEXTS], rtol=1e-12)
    want = [[0 if f[0] < least else (2 if low > 0 and x > low or low < 0 and -x > low else 1 if low > 0 and x <= good or low < 0 and -x <= good else 0)
             for name, least, low, good in quality.LABELLERS for x in [f[quality.QUALITY.index(name)]]] for f in map(slow_quality, TEXTS)]
    assert quality.votes(got).tolist() == want


def slow_em(patterns, counts, rounds=200):
    """The same model with loops: P(low | votes) of each pattern."""
    low = [0.9 if 2 in p else 0.1 for p in patterns]
    for _ in range(rounds):
        table, prior = {}, []
        for c in (0, 1):
            belief = [b if c else 1 - b for b in low]
            prior.append(sum(b * n for b, n in zip(belief, counts)) + 1)
            for k in range(len(patterns[0])):
                t = {v: 1 + sum(b * n for b, n, p in zip(belief, counts, patterns) if p[k] == v) for v in (1, 2)}
                table |= {(c, k, v): x / (t[1] + t[2]) for v, x in t.items()}
        new = []
        for p in patterns:
            odds = math.log(prior[1] / prior[0]) + sum(math.log(table[1, k, v] / table[0, k, v]) for k, v in enumerate(p) if v)
            new.append(1 / (1 + math.exp(-max(min(odds, 30), -30))))
        done = max(abs(a - b) for a, b in zip(new, low)) < 1e-9
        if done:
            return new
        low = new
    return new


def test_expectation_maximisation():
    rng = random.Random(6)
    docs = []
    for _ in range(600):
        bad = rng.random() < 0.2
        docs.append(tuple(rng.choice([0, 0, 1 + (rng.random() < (0.9 if bad else 0.1))]) for _ in quality.LABELLERS))
    kinds = Counter(docs)
    v = np.array(list(kinds))
    model, _ = quality.label_model(quality._pattern(v), np.array(list(kinds.values()), float))
    assert np.allclose(quality.posterior(v, model), slow_em(list(kinds), list(kinds.values())), atol=1e-6)


def test_the_scorer_sees_no_votes():
    alone = [quality.hashed(pa.array([t])) for t in TEXTS]
    doc, dim, value = quality.hashed(pa.array(TEXTS))
    for k, (_, d, v) in enumerate(alone):  # nor its neighbours
        assert dim[doc == k].tolist() == d.tolist() and value[doc == k].tolist() == v.tolist()
    x, y = np.array([0, 0, 1, 1, 2, 3]), np.array([1.0, 0.0, 0.9, 0.1])
    w = quality.fit_scorer(x, np.array([5, 7, 5, 8, 7, 5]), np.ones(6), y)
    assert w[5] != 0 and not w[np.setdiff1d(np.arange(quality.WIDTH), [5, 7, 8])].any()


PRONOUNS = np.sort(Words(pa.array(toxicity.PRONOUNS), ALNUM, fold=True).hashes())


def stem(word, n):
    return word[:n] if len(word) > n else None


def slow_toxic(text, lexicon):
    t = latin(text)
    w = [fold(x) for x in re.findall("[0-9A-Za-z\x80-\xff]+", t)]
    n = max(len(w), 1)
    odds = [[lexicon[0].get(x, 0.0), lexicon[1].get(stem(x, 4), 0.0), lexicon[2].get(stem(x, 6), 0.0)] for x in w]
    best = [max(o) for o in odds]
    exact, stems, second = sum(o[0] > 0 for o in odds), sum(o[1] > 0 or o[2] > 0 for o in odds), [x in toxicity.PRONOUNS for x in w]
    near = sum(b > 0 and any(second[max(i - toxicity.NEAR, 0) : i + toxicity.NEAR + 1]) for i, b in enumerate(best))
    meant = [fold(x) for x in re.findall("[0-9A-Za-z\x80-\xff]+", t.translate(str.maketrans("0134578@$", "oieastbas")))]
    hidden = sum(lexicon[0].get(x, 0) > 0 for x in meant) - exact
    parts = re.findall(SPACE, t)
    m = max(len(parts), 1)
    count = lambda p, x: len(re.findall(p, x))
    mixed = sum(count(LETTER, x) > 0 and count("[0-9]", x) + sum(c in SYMBOL for c in x) > 0 for x in parts) / m
    capital = sum(count("[A-Z]", x) >= 2 and count("[A-Z]", x) == count(LETTER, x) for x in parts) / m
    return [
        math.log1p(exact), 100 * exact / n, math.log1p(stems), 100 * stems / n, max(best, default=0), math.log1p(sum(round(b * 4096) for b in best) / 4096), math.log1p(near), 100 * sum(second) / n,
        math.log1p(max(hidden, 0)), mixed, capital, share(t, UPPER), share(t, MARK), share(t, "!"), share(t, SYMBOL), share(t, "0123456789"), math.log1p(len(w)),
    ]


LEXICON = [{"stupid": 2.5, "idiot": 3.3, "trash": 2.1, "word1": 2.7}, {"stup": 2.2, "toke": 2.03}, {"idioti": 4.0, "passwo": 2.9}]


def tables():
    out = []
    for kind, entries in enumerate(LEXICON):
        if kind == 0:
            key = Words(pa.array(list(entries)), ALNUM, fold=True).hashes()
        else:
            key = np.array([int.from_bytes(k.encode(), "little") for k in entries], np.uint64)
        order = np.argsort(key)
        out.append((key[order], np.array(list(entries.values()))[order]))
    return out


def test_toxicity_features_depend_on_the_text_alone():
    got = toxicity.features(pa.array(TEXTS), tables(), PRONOUNS)
    assert np.allclose(got, [slow_toxic(t, LEXICON) for t in TEXTS], rtol=1e-12)
    rng = random.Random(2)
    for _ in range(20):
        order = rng.sample(range(len(TEXTS)), rng.randint(1, len(TEXTS)))
        again = toxicity.features(pa.array([TEXTS[i] for i in order]), tables(), PRONOUNS)
        assert (again == got[order]).all()


def slow_grow(x, y):
    """Boosted trees by exhaustive search, one sample at a time; each sample's raw score."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, toxicity.CUTS + 2)[1:-1])).tolist() for c in x.T]
    score = [math.log((y.sum() + 1) / (len(y) - y.sum() + 1))] * len(y)
    for _ in range(toxicity.TREES):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        groups = [list(range(len(y)))]
        for _ in range(toxicity.DEPTH):
            halves = []
            for group in groups:
                best, split = 1e-6, None
                total_g, total_h = sum(g[i] for i in group), sum(h[i] for i in group)
                for f, options in enumerate(cuts):
                    for c in options:
                        left = [i for i in group if x[i, f] <= c]
                        a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                        if b < toxicity.LEAST or total_h - b < toxicity.LEAST:
                            continue
                        gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
                        if gain > best + 1e-9:
                            best, split = gain, (f, c)
                halves += [[i for i in group if split is None or x[i, split[0]] <= split[1]], [i for i in group if split is not None and x[i, split[0]] > split[1]]]
            groups = halves
        for group in groups:
            step = -toxicity.RATE * sum(g[i] for i in group) / (sum(h[i] for i in group) + 1)
            for i in group:
                score[i] += step
    return score


def test_trees(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 4)
    monkeypatch.setattr(toxicity, "CUTS", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3)).round(2)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=120) * 0.3 > 1).astype(float)
    assert np.allclose(toxicity.raw_scores(toxicity.grow(x, y), x), slow_grow(x, y), atol=1e-9)


def test_isotonic():
    rng = np.random.default_rng(4)
    raw, y = rng.integers(0, 15, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    values = np.unique(raw)
    mean = lambda a, b: y[(raw >= values[a]) & (raw <= values[b])].mean()
    want = [max(min(mean(a, b) for b in range(i, len(values))) for a in range(i + 1)) for i in range(len(values))]
    assert np.allclose(np.interp(values, *toxicity.isotonic(raw, y)), want)


@pytest.mark.parametrize("score,columns", [(quality.score_quality, ["posterior", "score"]), (lambda d: toxicity.score_toxicity(d, d.sparkSession.read.parquet(f"{SF}/labels.parquet")), ["score"])])
def test_scores_do_not_depend_on_partitions(spark, score, columns):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = docs.withColumn("doc_id", docs.doc_id + 10**6).union(docs.limit(5).withColumn("doc_id", docs.doc_id * 0 + None))
    one, two = (score(docs.unionByName(copies).repartition(n, "text")).toPandas() for n in (1, 7))
    key = ["doc_id", *columns]
    one, two = (f.sort_values(key)[key].reset_index(drop=True) for f in (one, two))
    pd.testing.assert_frame_equal(one, two, check_exact=True)
    first, copy = (one[m].sort_values("doc_id")[columns].to_numpy() for m in (one.doc_id < 10**6, one.doc_id >= 10**6))
    assert (first == copy).all()


def test_ids_are_those_of_the_tokenizer():
    """An untouched tokenizer, on texts that hold its added tokens and parts of them."""
    path = tokens.tokenizer_path()
    whole, fast, rng = Tokenizer.from_file(path), tokens.WordEncoder(path), random.Random(5)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "<|", "<|ENDOFTEXT|>", " ", "\n", "Hello", "don't", "ı", "é", "3.14", "a\x1cb", " ", "<|endoftext|><|endoftext|>", "x"]
    for k in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
