"""Token ids of whole texts with a public vocabulary, and their ORC files (operator 1)."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemill.llm.common import documents, input_columns, process_cache, shared_path

#: Entries that a worker's caches of words and of punctuation hold at most; others are encoded anew, with the same ids.
CACHE_WORDS, CACHE_MARKS = 500_000, 10_000
SPLIT, ODD = re.compile(r"[^\x20\x09-\x0D]+"), "\x1c\x1d\x1e\x1f"
#: Files whose offsets (16 bytes each) are broadcast on reading; those of more files are joined as Catalyst sees fit.
BROADCAST_FILES = 1 << 20
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """encode(text): the ids of Tokenizer.encode(text, add_special_tokens=False), as little-endian unsigned 32-bit bytes.

    For a vocabulary whose pre-tokenizer drops white space and whose merges never cross a word: a text's ids are then those
    of its white-space separated pieces, one after the other. Pieces are cached. A piece of Latin letters and trailing
    punctuation goes to the BPE model directly; any other piece goes through the whole tokenizer. Strings of added tokens
    (such as <|endoftext|>) get their own ids, as the tokenizer gives them: a text is cut at them first. One text of 100 MB
    is fine: nothing is kept but its pieces and ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens that strip, or match whole words or normalised text, are not supported")
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.mark = os.path.commonprefix(list(self.added))  # a text without it holds no added token
        self.model = self.whole.model
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        extra = iter(range(256, 512))
        self.byte = {b: chr(b) if b in keep else chr(next(extra)) for b in range(256)}
        self.pieces: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token, already lower-case: they are those of the word as a piece, too, if it is all letters."""
        ids = self.pieces.get(word)
        if ids is None:
            mapped = word if word.isascii() else "".join(map(self.byte.__getitem__, word.encode()))
            ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if len(self.pieces) < CACHE_WORDS and word.isalpha():
                self.pieces[word] = ids
        return ids

    def _marks(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._word(marks)
            if len(self.marks) < CACHE_MARKS:
                self.marks[marks] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        core = piece.rstrip(PUNCTUATION)
        low = core.lower()
        if core.isalpha() and len(core) < 1000 and (core.isascii() or len(low) == len(core) and max(core) < "ɐ" and unicodedata.is_normalized("NFC", core)):
            ids = self._word(low)
            if len(core) < len(piece):
                ids += self._marks(piece[len(core) :])
            elif low == piece:
                return ids
        else:
            ids = array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(self.pieces) < CACHE_WORDS:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.cut is None or self.mark not in text:
            return self._plain(text)
        return b"".join([self.added.get(p) or self._plain(p) for p in self.cut.split(text)])

    def _plain(self, text: str) -> bytes:
        get, miss = self.pieces.get, self._piece
        # str.split() also cuts at 0x1C to 0x1F, which the tokenizer keeps
        parts = SPLIT.findall(text) if any(c in text for c in ODD) else text.split()
        return b"".join([get(p) or miss(p) for p in parts])


def encoder(path: str) -> WordEncoder:
    """This worker's encoder."""
    cache = process_cache()
    if getattr(cache, "encoder_path", None) != path:
        cache.encoder, cache.encoder_path = WordEncoder(path), path
    return cache.encoder


def ids_type() -> pa.DataType:
    return pa.schema([("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode_partition(path: str, end_id: int):
    def run(batches):
        enc, tail, start, schema = encoder(path), np.array([end_id], "<u4").tobytes(), 0, ids_type()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                blobs = [enc.encode(t) + tail for t in part.column(1).to_pylist()]
                n = np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs))
                ends = np.concatenate([[0], np.cumsum(n)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + ends[:-1]), pa.array(n), ids], schema=schema)
                start += int(ends[-1])

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes each text's token ids and end_id as ORC, in ascending id order over the part files.

    Files are range-partitioned and sorted by id, so stripes and row groups hold disjoint id ranges: readers take stripes
    in parallel, and an id lookup prunes files, stripes and row groups by statistics and Bloom filters before reading ids
    (run-length encoded integers). local_start counts the ids before a document within its file, and the files' sums give
    the rest, so that no global order needs one task. Null texts are empty (one id, the end); null ids come first;
    repeated ids are kept, in order of their text; other columns are ignored; an empty table makes files without rows.
    """
    ranged = input_columns(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ranged.mapInArrow(encode_partition(vocabulary, end_id), "doc_id long, local_start long, n_tokens long, ids array<int>")
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000").option("orc.stripe.size", str(64 << 20)).option("compression", "zstd").orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of write_token_files(); start counts the ids of all documents before."""
    schema = "doc_id long, local_start long, n_tokens long, ids array<int>"
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = spark.read.schema(schema).orc(path).withColumn("part", part)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row a file: some MB for a million files
    before = sums.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    files = len(spark.read.schema(schema).orc(path).inputFiles())
    return rows.join(F.broadcast(before) if files <= BROADCAST_FILES else before, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _digest(batches):
    for batch in batches:
        ids = batch.column(3)
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) * 4 if len(ids) else np.zeros(1, np.int64)
        view = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4"))).cast("B")
        crc = [zlib.crc32(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), path, tokenizer_path(), 2)
    return read_token_files(spark, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
