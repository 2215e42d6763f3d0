"""Two tokenizers' tokens of the same texts, aligned by bytes, and how usual each linked id pair is (operator 13)."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemill.llm.common import documents, input_columns, materialize, process_cache, remove, session_conf
from tidemill.llm.tokens import tokenizer_path

#: What a worker's cache of aligned segments holds at most, in entries and in pairs and characters; then it starts anew.
CACHE_SEGMENTS, CACHE_UNITS = 400_000, 8 << 20
#: Characters of text that are split at once, and postings that are kept before they are added up.
PART, PENDING = 1 << 20, 2 << 20
#: A side id with at least this share of the posting rows is dealt over shards; at most 1 / SIDE_SHARE ids are.
SIDE_SHARE = 1e-3
SEGMENT_START = re.compile(r"(?<=\S)(?=[ \n])")
UNEVEN = re.compile(r"\s[ \n]|\x00")


class Aligner:
    """Segments of texts, aligned once and cached.

    A segment starts at a blank or a line feed after a character that is no white space. Both tokenizers end a token there
    (A's pattern takes white space only before other characters; no piece of B has a blank or a line feed after another
    character), and what they do in a segment does not depend on the rest. So tokens, groups and links of a text are those
    of its segments, one after the other. B's vocabulary is looked through for pieces that would break this.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.encode_a = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = [chr(b) for b in keep] + [chr(256 + i) for i in range(256 - len(keep))]
        vocabulary = self.a.get_vocab()
        if not all(c in vocabulary for c in byte):
            raise ValueError("A must be a byte-level vocabulary that spells every byte")
        self.size_a = {i: len(t) for t, i in vocabulary.items()}  # a character a byte
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("a vocabulary whose pieces reach over blanks or line feeds is not supported")
        self.blank = self.b.piece_to_id("▁")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b = [len(p) for p in self.bytes_b]
        self.clear()

    def clear(self) -> None:
        """Forgets all segments. Segment s has pairs keys[at[s]:at[s + 1]] (A's id, then B's), each times[...] times."""
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.keys, self.times, self.at, self.units = array("q"), array("i"), array("q", [0]), 0
        self.numbers = array("q")  # valid, tokens of A, tokens of B, groups, links of each segment

    def segments(self, text: str) -> list[str]:
        if UNEVEN.search(text):
            return SEGMENT_START.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]

    def find(self, segments: list[str]) -> np.ndarray:
        """The number of each segment; those not seen before are aligned."""
        get = self.index.get
        found = [get(s, -1) for s in segments]
        if -1 in found:
            fresh = list(dict.fromkeys(s for s, i in zip(segments, found) if i < 0))
            for start in range(0, len(fresh), 4096):
                some = fresh[start : start + 4096]
                ids_a = [e.ids for e in self.encode_a(some, add_special_tokens=False)]
                for s, a, b in zip(some, ids_a, self.b.encode([s[1:] if s[0] == " " else s for s in some], num_threads=1)):
                    if s[0] != " ":
                        b = b[1:] if b[:1] == [self.blank] else []  # the blank that B puts before
                    self._add(s, a, b if s != " " else [self.blank])
            found = [get(s) for s in segments]
        return np.array(found, np.int64)

    def _add(self, segment: str, a: list[int], b: list[int]) -> None:
        size_a, size_b = self.size_a, self.size_b
        valid = b"".join([self.bytes_b[j] for j in b]) == segment.encode()  # A's bytes are always the text's
        groups, pairs, n, k = "", {}, 0, 0
        if valid:
            i = j = i0 = j0 = 0
            end_a, end_b, last_a, last_b = size_a[a[0]], size_b[b[0]], len(a) - 1, len(b) - 1
            while True:  # each step is a pair that overlaps; the token that ends first moves on
                pair = a[i] << 32 | b[j]
                pairs[pair] = pairs.get(pair, 0) + 1
                n += 1
                if end_a == end_b:
                    k += 1
                    group = f"{a[i]}|{b[j]}" if i == i0 and j == j0 else ",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1]))
                    if i == last_a and j == last_b:
                        groups += group
                        break
                    groups += group + ";"
                    i0 = i = i + 1
                    j0 = j = j + 1
                    end_a += size_a[a[i]]
                    end_b += size_b[b[j]]
                elif end_a < end_b:
                    i += 1
                    end_a += size_a[a[i]]
                else:
                    j += 1
                    end_b += size_b[b[j]]
        self.index[segment] = len(self.groups)
        self.groups.append(groups)
        self.keys.extend(pairs)
        self.times.extend(pairs.values())
        self.at.append(len(self.keys))
        self.numbers.extend((valid, len(a), len(b), k, n))
        self.units += len(segment) + 2 * len(pairs)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Copies: arrays that NumPy looks into can't grow."""
        return np.array(self.keys, np.int64), np.array(self.times, np.int64), np.array(self.at, np.int64), np.array(self.numbers, np.int64).reshape(-1, 5)


def parts(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(document, stretch of its text) in lists of some PART characters. A blank goes before each text; long texts are cut
    where a segment starts; empty ones are left out."""
    some, size = [], 0
    for d, text in enumerate(texts):
        text, start = " " + text if text else "", 0
        while start < len(text):
            cut = SEGMENT_START.search(text, start + PART) if len(text) - start > PART else None
            end = cut.start() if cut else len(text)
            some.append((d, text[start:end]))
            size, start = size + end - start, end
            if size >= PART:
                yield some
                some, size = [], 0
    if some:
        yield some


def summed(keys: np.ndarray, docs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of times by (key, document), in that order."""
    if not len(keys):
        return keys, docs, times
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])]))
    return keys[first], docs[first], np.add.reduceat(times[order], first)


def align_texts(aligner: Aligner, texts: list[str | None]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: (valid, tokens of A, of B, groups, links) and the groups' digest; and the postings (pair, document,
    times) of all valid ones."""
    n = len(texts)
    totals, valid, digests, pending = np.zeros((n, 5), np.int64), np.array([bool(t) for t in texts], bool), {}, []
    for some in parts(texts):
        if len(aligner.index) > CACHE_SEGMENTS or aligner.units > CACHE_UNITS:
            aligner.clear()
        split = [aligner.segments(t) for _, t in some]
        number = aligner.find([s for part in split for s in part])
        counts = [len(part) for part in split]
        doc = np.repeat(np.array([d for d, _ in some]), counts)
        keys, times, at, numbers = aligner.tables()
        rows = numbers[number]
        valid[np.unique(doc[rows[:, 0] == 0])] = False
        for column in range(1, 5):
            totals[:, column] += np.bincount(doc, rows[:, column], n).astype(np.int64)
        start, names = 0, aligner.groups
        listed = number.tolist()
        for (d, _), count in zip(some, counts):
            text = ";".join([names[s] for s in listed[start : start + count]]).encode()
            if d in digests:
                digests[d].update(b";" + text)
            else:
                digests[d] = hashlib.sha256(text)
            start += count
        used, again = np.unique(doc * len(names) + number, return_counts=True)
        of_doc, of_segment = used // len(names), used % len(names)
        size = at[of_segment + 1] - at[of_segment]
        place = np.repeat(at[of_segment] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pending.append(summed(keys[place], np.repeat(of_doc, size), times[place] * np.repeat(again, size)))
        if sum(len(p[0]) for p in pending) > PENDING:
            pending = [summed(*map(np.concatenate, zip(*pending)))]
    totals[:, 0] = valid
    totals[~valid] = 0
    keys, docs, times = summed(*map(np.concatenate, zip(*pending))) if pending else (np.zeros(0, np.int64),) * 3
    ok = valid[docs]
    return totals, [digests[d].hexdigest() if valid[d] else "" for d in range(n)], (keys[ok], docs[ok], times[ok])


BLOCK_SCHEMA = "block long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, n int, docs array<int>, times array<int>"


def _blocks(a_path: str, b_path: str):
    def run(batches):
        cache = process_cache()
        if getattr(cache, "aligner_paths", None) != (a_path, b_path):
            cache.aligner, cache.aligner_paths = Aligner(a_path, b_path), (a_path, b_path)
        int32, ints = pa.int32(), pa.list_(pa.int32())
        for k, batch in enumerate(batches):
            block = TaskContext.get().partitionId() << 32 | k
            totals, digests, (keys, docs, times) = align_texts(cache.aligner, batch.column(1).to_pylist())
            n = batch.num_rows
            blank = [pa.nulls(n, int32)] * 3 + [pa.nulls(n, ints)] * 2
            names = ["block", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n", "docs", "times"]
            numbers = [pa.array(totals[:, c]) for c in range(1, 5)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), batch.column(0), *numbers, pa.array(digests, pa.string()), *blank], names=names)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            ends = np.append(first, len(keys)).astype(np.int32)
            pair, m = keys[first], len(first)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (docs, times)]
            blank = [pa.nulls(m, int32), *[pa.nulls(m, pa.int64())] * 5, pa.nulls(m, pa.string())]
            sides = [pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(np.diff(ends))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), *blank, *sides, *lists], names=names)

    return run


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, count, best) of postings (a, b, n): the documents that hold the pair, and whether no pair of a has more. Counts are
    added up before they are shuffled; a side's partners are a vocabulary's size at most."""
    counts = postings.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("a")))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    1. Each batch of texts (4 MB, or one longer text) is a block. Its tokens are aligned, and each id pair linked in it is a row
       with the documents that hold it and how often: their multiplicities, as a sorted list.
    2. These rows are dealt by side id (A's) and sorted, and so are the pairs' counts and their side's maximum, which meet them as
       two sorted streams that spill. A side with a large share of the rows is dealt over shards by block, and its counts go to
       each shard.
    3. What each pair adds to its documents goes back by block and is summed by document.

    Every row is a document, also one of a repeated or null id. Null and empty texts, and texts that either tokenizer does not
    give back byte for byte (such as those with U+2581), have zeros and an empty digest. Other columns are ignored. No
    documents: no rows.
    """
    spark = docs.sparkSession
    table = materialize(input_columns(docs, id_col, text_col).mapInArrow(_blocks(a_path, b_path), BLOCK_SCHEMA), "aligned")
    postings = table.where("a IS NOT NULL").select("block", "a", "b", "n", "docs", "times")
    sides = postings.groupBy("a").agg(F.count(F.lit(1)).alias("rows"))
    total = sides.agg(F.sum("rows")).first()[0] or 0
    heavy = sides.where(F.col("rows") >= max(1000.0, SIDE_SHARE * total)).select("a", F.ceil(F.col("rows") / max(1.0, SIDE_SHARE * total)).cast("int").alias("shards"))
    heavy = materialize(heavy, "sides")  # 1 / SIDE_SHARE rows at most
    shards = F.coalesce("shards", F.lit(1))
    dealt = postings.join(F.broadcast(heavy), "a", "left").withColumn("shard", F.pmod(F.xxhash64("block"), shards).cast("int")).drop("shards").repartition("a", "shard")
    counts = materialize(pair_counts(postings), "pairs")
    spread = counts.join(F.broadcast(heavy), "a", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1))).drop("shards").repartition("a", "shard")
    met = dealt.hint("merge").join(spread, ["a", "shard", "b"]).select("block", "docs", "times", "count", "best").repartition("block")
    each = met.select("block", "count", "best", F.explode(F.arrays_zip("docs", "times")).alias("x"))
    own = table.where("a IS NULL").select("block", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    stats = [c for c in own.columns if c not in ("block", "doc")]
    added = each.select("block", F.col("x.docs").alias("doc"), F.when(F.col("best"), F.col("x.times")).otherwise(0).cast("long").alias("n_best"), (F.col("count") * F.col("x.times")).alias("count_sum"))
    sums = added.groupBy("block", "doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    joined = own.join(sums, ["block", "doc"], "left").select(*stats[:-1], F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    with session_conf(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):  # dealt by side alone
        done = materialize(joined, "alignment")
    for t in (table, heavy, counts):
        remove(t)
    return done


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
