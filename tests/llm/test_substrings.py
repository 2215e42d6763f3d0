"""Repeated passages against brute force: built collisions, crowds, long texts, repeated and null ids."""

import random

import pyarrow as pa
import pytest

from test_operators import SPACES, sha
from tidemill.llm import substrings
from tidemill.llm.textvec import NOT_SPACE, Words


def slow(rows, window=13):
    words = [(d, SPACES.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d or 0, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def found(spark, rows, **more):
    frame = spark.createDataFrame([(d, t, 1, 2, "x", "y") for d, t in rows], "doc_id long, text string, th int, rep int, piece string, shard string").repartition(3)
    return sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame, **more).collect())


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_structured_words_do_not_clash(spark):
    same = " ".join(f"w{i}" for i in range(12))
    rows = []
    for k, n in enumerate((64, 256, 512, 1024, 2048, 100_000)):
        word = thue_morse(n)[:n]
        rows += [(10 * k + 1, f"{same}{k} {word}"), (10 * k + 2, f"{same}{k} {word.translate(str.maketrans('ab', 'ba'))}")]
    assert found(spark, rows) == slow(rows) and not any(r[2] for r in found(spark, rows))
    hashes = Words(pa.array([t for _, t in rows]), NOT_SPACE, fold=False).hashes()
    assert len(set(hashes.tolist())) == len({w for _, t in rows for w in t.split()})


def made(rng, n=160):
    pool = [[f"p{k}_{i}" for i in range(rng.choice([13, 14, 40, 90]))] for k in range(12)]
    loops = ["la"] * 30, ["a", "b"] * 12
    rows = []
    for k in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice([*pool, *loops])
            i = rng.randrange(len(part))
            w += rng.choice([part, part[i:], part[: i + 13]]) + [f"u{rng.randrange(9)}" for _ in range(rng.choice([0, 1, 3, 40]))]
        rows.append((rng.choice([k, k, k, rng.randrange(n), None, 7]), "  ".join(w)))
    rows += [(k, rows[3][1] or "z " * 20) for k in range(200, 260)]  # a crowd of exact copies
    rows += [(5, rows[10][1])] * 9 + [(300, " ".join(w for p in pool for w in p) * 3), (301, None), (302, ""), (None, None)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings, "PIECE", [512, 7, 20][seed])
    monkeypatch.setattr(substrings, "SHARD_WINDOWS", [1 << 15, 30, 100][seed])
    monkeypatch.setattr(substrings, "AUTOMATON_WINDOWS", [1 << 16, 10, 50][seed])
    monkeypatch.setattr(substrings, "STREAM_BYTES", [4 << 20, 2000, 500][seed])
    monkeypatch.setattr(substrings, "GROUP_BYTES", [2 << 20, 3000, 1000][seed])
    monkeypatch.setattr(substrings, "SEED_PLACES", [32, 1, 2][seed])
    rows = made(random.Random(seed))
    assert found(spark, rows) == slow(rows)


@pytest.mark.parametrize("places", [32, 1, 0])
def test_located_ranges(monkeypatch, places):
    """Texts of few words, with many seeds in many places, against all windows."""
    monkeypatch.setattr(substrings, "SEED_PLACES", places)
    rng = random.Random(places)
    for _ in range(150):
        window, letters = rng.choice([2, 3, 5, 13]), rng.choice(["ab", "abcd"])
        make = lambda n: [rng.choice(letters) for _ in range(n)]
        passages = [(rng.randrange(6), make(rng.randint(window, 4 * window))) for _ in range(rng.randint(1, 8))]
        text = make(60) + rng.choice(passages)[1] + make(5)
        own = rng.randrange(7)
        known = {tuple(w[i : i + window]) for rep, w in passages if rep < own for i in range(len(w) - window + 1)}
        want = {j for i in range(len(text) - window + 1) if tuple(text[i : i + window]) in known for j in range(i, i + window)}
        got = set()
        for letter, automaton in substrings._automata([(rep, " ".join(w)) for rep, w in passages], window):
            for a, b in substrings._located("".join(letter.get(w, "\0") for w in text), automaton, own, window):
                got.update(range(a, b))
        assert got == want


def test_the_automata_give_the_result(spark, monkeypatch):
    """Without what the automata find, only whole copies are known."""
    rows = made(random.Random(9))
    monkeypatch.setattr(substrings, "_automata", lambda passages, window: iter(()))
    assert found(spark, rows) != slow(rows)


def test_a_saturated_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SKETCH_LEAST", 64)
    monkeypatch.setattr(substrings, "SKETCH_BITS", 64)
    rows = made(random.Random(4))
    assert found(spark, rows) == slow(rows)


def test_query_columns(spark, odd):
    assert {len(r.kept_sha256) for r in substrings.op6_substrings(spark, odd).collect()} == {len(sha(""))}
