"""Fingerprints, stripped lines and aligned tokens against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest import ODD
from oracle import SF
from tidemill.llm.lines import op12_lines
from tidemill.llm import alignment, fingerprints, lines

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_text(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


# --- fingerprints

def slow_print(text):
    """Votes added up term by term."""
    words, votes = [w for w in re.split("[\x20\x09-\x0d]+", text.translate(lines_lower)) if w], np.zeros(256, int)
    column = pa.array([text])
    doc, hashes, _ = fingerprints.terms(column)
    assert len(hashes) == max(len(words) - 1, min(len(words), 1))
    for h, n in collections.Counter(hashes.tolist()).items():
        spelled = b"".join(int(fingerprints.mix(np.array([(h + fingerprints.P * (k + 1)) % 2**64], np.uint64))[0]).to_bytes(8, "little") for k in range(4))
        bits = np.array([int(b) for byte in spelled for b in f"{byte:08b}"])
        votes += (1 + int(np.log2(n))) * (2 * bits - 1)
    return np.packbits(votes > 0).tobytes()


lines_lower = str.maketrans(lines.UPPER, lines.LOWER)


def expected_prints(docs):
    texts = [(d, t or "") for d, t in docs]
    texts = [texts[i] for i in sorted(range(len(texts)), key=lambda i: -texts[i][0])]
    prints = [slow_print(t) for _, t in texts]
    differ = lambda a, b: (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    for k, (d, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        again, other = slow_print(new), prints[(k + 1) % len(texts)]
        near = sum(differ(prints[k], p) <= fingerprints.RADIUS for p in prints) - 1
        yield d, len(t), sha(new), prints[k].hex(), again.hex(), 1 - differ(prints[k], again) / 256, 1 - differ(prints[k], other) / 256, near


COPIES = [(200 + i, "one two three four five six seven eight nine ten " * 30 + f"tail{i % 7}") for i in range(30)]


@pytest.mark.parametrize("tile", [4096, 4])
def test_fingerprints(spark, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(fingerprints, "TILE", tile)
    docs = [r for r in {d: (d, t) for d, t in ODD if d is not None and len(t or "") < 2000}.values()] + COPIES
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS n", "'x' AS part", "0 AS edge", "1 AS _h").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = fingerprints.op11_fingerprints(spark, str(tmp_path)).collect()
    assert by_text(map(tuple, found)) == by_text(expected_prints(docs))


def test_fingerprints_of_repeated_ids(spark, odd):
    found = fingerprints.op11_fingerprints(spark, odd).toPandas()
    assert len(found) == len(ODD) and sorted(found.n_chars) == sorted(len(t or "") for _, t in ODD)
    assert found[found.doc_id == 8].fingerprint.nunique() == 1
    one = spark.createDataFrame([(1, "alone here now")], "doc_id long, text string")
    row = fingerprints.fingerprint_documents(one).first()
    assert row.near_next == 1 and row.edited_sha256 == sha("alone h" + "alone h")


def test_edited_texts_are_nearer(spark):
    found = fingerprints.op11_fingerprints(spark, SF).toPandas()
    assert (found.near_edited > found.near_next).mean() > 0.95


# --- lines

def strip(docs):
    seen, first, total, removed, rows = collections.Counter(), {}, collections.Counter(), collections.Counter(), []
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lines_lower)
    batch = lambda d: 8 * (zlib.crc32(("" if d is None else str(d)).encode()) % 64) // 64
    for b in range(8):
        now = collections.Counter()
        for d, text in docs:
            if batch(d) == b:
                all_lines = (text or "").split("\n")
                kept = []
                for line in all_lines:
                    if len(key(line)) >= 10 and seen[key(line)] >= 5:
                        removed[key(line)] += 1
                        first.setdefault(key(line), b)
                    else:
                        kept.append(line)
                rows.append(("doc", None if d is None else str(d), b, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept))))
                now.update({key(line) for line in all_lines})
        seen += now
    return rows + [("line", sha(k), first[k], seen[k], n, None) for k, n in removed.items()]


def test_lines(spark, tmp_path):
    common = ["A line that many hold", "  a LINE that many hold\t", "short", "", "ÄÖÜ äöü line", "äöü äöü line"]
    docs = ODD + [(1000 + i, "\n".join([common[i % 6], f"own line number {i}", common[(i // 2) % 6], "x" * 9, "\r", common[0] if i % 3 else "", common[0]]) + "\n" * (i % 3)) for i in range(120)]
    docs += [(5000, "\n".join(["A line that many hold"] * 2500)), (5001, "a line that many hold"), (5002, None)] + [(5003, "a line that many hold")] * 3
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS batch", "2 AS key", "'x' AS row", "0 AS n").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = lines.op12_lines(spark, str(tmp_path))
    assert found.columns == ["row_kind", "row_id", "batch", "n_all", "n_removed", "kept_sha256"]
    assert by_text(map(tuple, found.collect())) == by_text(strip(docs))


def test_lines_of_few_batches(spark, tmp_path):
    """Batches without documents, the last one too."""
    docs = [(i, "the same line in all of them") for i in range(300) if zlib.crc32(str(i).encode()) % 64 // 8 in (1, 4)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = by_text(map(tuple, lines.op12_lines(spark, str(tmp_path)).collect()))
    assert found == by_text(strip(docs)) and any(r[0] == "line" for r in found)


# --- alignment

def aligned(docs):
    """All pairs of overlapping tokens, counted over all documents."""
    a_model, b_model = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(keep)))}
    held, done = collections.Counter(), []
    for d, text in docs:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        spelled = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        pieces = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(spelled) == b"".join(pieces) == (" " + text).encode():
            done.append((d, None))
            continue
        ends = [np.cumsum([len(x) for x in side]) for side in (spelled, pieces)]
        starts = [np.append(0, e[:-1]) for e in ends]
        links = [(a[i], b[j]) for i in range(len(a)) for j in np.flatnonzero((starts[1] < ends[0][i]) & (ends[1] > starts[0][i]))]
        shared = np.intersect1d(*ends)
        cut = [np.searchsorted(e, shared, "right").tolist() for e in ends]
        groups = ";".join(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])) for i0, i, j0, j in zip([0] + cut[0], cut[0], [0] + cut[1], cut[1]))
        held.update(set(links))
        done.append((d, (len(a), len(b), len(shared), links, sha(groups))))
    top = collections.Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    for d, x in done:
        yield (d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, *x[:3], len(x[3]), sum(held[p] == top[p[0]] for p in x[3]), sum(held[p] for p in x[3]), x[4])


STRANGE = ["a▁b", " ", "  \n\n  x \n y\n\nz ", "tab\tend\r\n\r\nmixed　wide  nb \x85 nel \x1c x", "x" * 5000, "\n", "\nabc", "abc\n", "abc ", "\x00 a\x00b c", "don't I'll  <s> </s> <unk> <0x0A> <|endoftext|>", "日本語 テキスト 。 한국어 \U0001f600\U0001f600", "a \n b  \n  c"]


@pytest.mark.parametrize("part", [1 << 20, 50])
def test_alignment(spark, monkeypatch, part):
    monkeypatch.setattr(alignment, "PART", part)
    docs = [r for r in ODD if len(r[1] or "") < 2000] + [(100 + i, t) for i, t in enumerate(STRANGE)]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS a", "2 AS b", "'x' AS block", "0 AS n", "1 AS docs").repartition(3)
    found = alignment.align(table, A_PATH, B_PATH)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert by_text(map(tuple, found.collect())) == by_text(aligned(docs))


def test_alignment_of_documents(spark, monkeypatch):
    """Whole texts of the small table; every side dealt over shards, and a cache that starts anew all the time."""
    monkeypatch.setattr(alignment, "SIDE_SHARE", 1e-9)
    monkeypatch.setattr(alignment, "CACHE_SEGMENTS", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert by_text(map(tuple, alignment.align(docs, A_PATH, B_PATH).collect())) == by_text(aligned(map(tuple, docs.collect())))


def test_long_texts_and_segments():
    """A text in many parts, and a word of 300,000 letters."""
    aligner = alignment.Aligner(A_PATH, B_PATH)
    for text in (" ".join(f"word{i % 977} Token{i}" for i in range(60_000)), "ab" * 150_000):
        totals, digests, (keys, docs, times) = alignment.align_texts(aligner, [text])
        a, b = len(aligner.a.encode(" " + text, add_special_tokens=False).ids), len(aligner.b.encode(text))
        assert totals[0, :3].tolist() == [1, a, b] and times.sum() == totals[0, 4]


def test_lines_leave_no_state_store_open(spark):
    """Each of the eight starts has stores of its own; none may stay in an executor's memory after its batch."""
    manager = spark._jvm.org.apache.spark.sql.execution.streaming.state.RocksDBMemoryManager
    before = [manager.getNumRocksDBInstances(bounded) for bounded in (True, False)]
    op12_lines(spark, SF).count()
    assert [manager.getNumRocksDBInstances(bounded) for bounded in (True, False)] == before
