"""Removal of repeated passages through sharded Aho-Corasick automata of confirmed passages (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents, heavy_split_join, materialize, remove
from tidemill.llm.textvec import NOT_SPACE, Words, joined, mix, ngrams, per_document, slices

WINDOW = 13
#: Words of the shorter phrase whose least hash within a window stands for that window.
PHRASE = 5
#: Windows of a piece of text: what is sent to an automaton at once.
PIECE = 512
#: Least and most bits of the sketch of recurring phrases that goes to all tasks (at most 32 MB), and its bits a phrase.
SKETCH_LEAST, SKETCH_BITS, SKETCH_PER = 1 << 20, 1 << 28, 32
#: Passage windows of a shard and of an automaton, and bytes of text that a task streams through its shard's automata.
SHARD_WINDOWS, AUTOMATON_WINDOWS, STREAM_BYTES = 1 << 15, 1 << 16, 4 << 20
#: Places of a seed in an automaton's passages beyond which whole windows are its patterns instead.
SEED_PLACES = 32
#: Bytes of text whose windows are looked up by one task.
GROUP_BYTES = 2 << 20


# --- pieces of distinct texts


def _cut(window: int, size: int):
    """Pieces (piece, th, at, rep, text) of texts of a window at least: `size` windows each, so that every window of a text is
    in one piece; words are joined by one space."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(2)):
                words = Words(batch.column(2).slice(a, b - a), NOT_SPACE, fold=False)
                number = np.where(words.counts >= window, -(-(words.counts - window + 1) // size), 0)
                doc = np.repeat(np.arange(words.n), number)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                first = words.at[doc] + k * size
                last = np.minimum(first + size + window - 1, words.at[doc + 1])
                spelled, place = words.spelled()
                texts = [spelled[i : j - 1] for i, j in zip(place[first].tolist(), place[last].tolist())]
                th, rep = (batch.column(c).slice(a, b - a).to_numpy()[doc] for c in (0, 1))
                piece = mix(th.view(np.uint64) + mix(k.astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece.view(np.int64)), pa.array(th), pa.array(k * size), pa.array(rep), pa.array(texts, pa.binary()).cast(pa.string())], names=["piece", "th", "at", "rep", "text"]
                )

    return run


# --- recurring windows


def _windows(column: pa.Array, window: int, phrase: int):
    """Words of the texts; for each window: its first word, its hash and the least phrase hash in it."""
    words = Words(column, NOT_SPACE, fold=False)
    hashes = words.hashes()
    at = np.flatnonzero(words.fits(window))
    if not len(at):
        return words, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    short, span = ngrams(hashes, phrase), window - phrase + 1
    least = short[: len(short) - span + 1].copy()
    for j in range(1, span):
        np.minimum(least, short[j : j + len(least)], out=least)
    return words, at, ngrams(hashes, window)[at], least[at]


def _hashes(window: int, phrase: int, sketch: np.ndarray | None):
    """(hash, rep, piece) of phrases that stand for windows; with a sketch of the recurring ones, of the windows that such
    phrases stand for. What repeats in a row is left out."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(2)):
                words, at, value, least = _windows(batch.column(2).slice(a, b - a), window, phrase)
                doc = words.doc()[at]
                if sketch is None:
                    value = least
                else:
                    bit = least % np.uint64(len(sketch) * 8)
                    seen = sketch[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
                    value, doc = value[seen], doc[seen]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                piece, rep = (batch.column(c).slice(a, b - a).to_numpy()[doc[new]] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(value[new].view(np.int64)), pa.array(rep), pa.array(piece)], names=["hash", "rep", "piece"])

    return run


def _sketch(hashes: DataFrame, bits: int = 1 << 26) -> np.ndarray:
    """A bit for each hash modulo bits; bits / 64 rows at most come to the driver."""
    bit = F.expr(f"hash & {bits - 1}L")  # the unsigned remainder
    rows = hashes.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63L AS INT))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


# --- passages and the texts that meet them

DEALT = pa.schema([("shard", pa.int32()), ("rep", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("passage", pa.bool_()), ("text", pa.string())])


def _deal(window: int, phrase: int):
    """For a group of pieces and what is known of them: the passages they hold first, for their own shard, and their text
    for each shard that holds some of their windows."""

    def run(known, pieces):
        out, column = [], pieces["text"].combine_chunks()
        piece, rep, th, at_word, own = (pieces[c].to_numpy() for c in ("piece", "rep", "th", "at", "own"))
        of, hashes, shard = known["piece"].to_numpy(), known["hash"], known["shard"]
        owns = hashes.is_valid().to_numpy() if len(known) else np.zeros(0, bool)
        owned = np.stack([of[owns], hashes.drop_null().to_numpy()], axis=1) if owns.any() else np.zeros((0, 2), np.int64)
        owned = mix(mix(owned[:, 0].view(np.uint64)) + owned[:, 1].view(np.uint64)) if len(owned) else np.zeros(0, np.uint64)
        owned.sort()
        visits = np.stack([of[~owns], shard.drop_null().to_numpy()], axis=1) if (~owns).any() else np.zeros((0, 2), np.int64)
        visits = visits[np.argsort(visits[:, 0], kind="stable")]
        for a, b in slices(column):
            if len(owned):
                words, at, full, _ = _windows(column.slice(a, b - a), window, phrase)
                doc = words.doc()[at]
                key = mix(mix(piece[a:b].view(np.uint64))[doc] + full)
                hit = np.flatnonzero(owned[np.minimum(np.searchsorted(owned, key), len(owned) - 1)] == key)
                if len(hit):  # windows in a row make one passage
                    cut = np.flatnonzero((np.diff(at[hit]) != 1) | (np.diff(doc[hit]) != 0)) + 1
                    first, last = hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])]
                    spelled, place = words.spelled()
                    texts = [spelled[i : j - 1] for i, j in zip(place[at[first]].tolist(), place[at[last] + window].tolist())]
                    d = doc[first] + a
                    columns = [own[d], rep[d], np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), np.ones(len(d), bool)]
                    out.append(pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(texts, pa.binary()).cast(pa.string())], schema=DEALT))
            lo, hi = np.searchsorted(visits[:, 0], piece[a:b]), np.searchsorted(visits[:, 0], piece[a:b], "right")
            d = np.repeat(np.arange(b - a), hi - lo)
            if len(d):
                place = np.arange(len(d)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[d]
                columns = [visits[place, 1].astype(np.int32), rep[a + d], th[a + d], at_word[a + d], np.zeros(len(d), bool)]
                out.append(pa.RecordBatch.from_arrays([*map(pa.array, columns), column.take(pa.array(a + d))], schema=DEALT))
        return pa.Table.from_batches(out, schema=DEALT)

    return run


# --- automata

SPANS = pa.schema([("th", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _automata(passages: list[tuple[int, str]], window: int):
    """Automata of AUTOMATON_WINDOWS windows each: (letter of each word, automaton). A word is a letter, exactly.

    Patterns are seeds: the words at every `step`-th place of a passage, of such length that each window holds one whole. A
    seed's value is a list of (passage's id, its letters, place). A seed of over SEED_PLACES places (a phrase in very many
    contexts) is left out; the windows around its places are patterns of their own then, of value (least id,).
    """
    import ahocorasick

    step, passages = (window + 1) // 2, sorted(passages)  # the smallest id comes first and stays
    k = 0
    while k < len(passages):
        letters, seeds, windows = {}, {}, 0
        while k < len(passages) and windows < AUTOMATON_WINDOWS:
            rep, text = passages[k]
            for w in (words := text.split(" ")):
                if w not in letters:
                    letters[w] = chr(len(letters) + 1 + 0x800 * (len(letters) + 1 >= 0xD800))  # not a surrogate
            spelled = "".join([letters[w] for w in words])
            for i in range(0, len(words) - window + step, step):
                seeds.setdefault(spelled[i : i + window - step + 1], []).append((rep, spelled, i))
            windows += len(words) - window + 1
            k += 1
        automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            if len(places) <= SEED_PLACES:
                automaton.add_word(seed, places)
            else:
                for rep, spelled, i in places:
                    for j in range(max(i - step + 1, 0), min(i, len(spelled) - window) + 1):
                        whole = spelled[j : j + window]
                        automaton.add_word(whole, min((rep,), automaton.get(whole, (rep,))))
        automaton.make_automaton()
        yield letters, automaton


def _run(a: str, i: int, b: str, j: int) -> int:
    """Letters that a from i on and b from j on have in common."""
    n, most = 0, min(len(a) - i, len(b) - j)
    while n < most and a[i + n : i + min(n + 64, most)] == b[j + n : j + min(n + 64, most)]:
        n = min(n + 64, most)
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def _located(text: str, automaton, own: int, window: int):
    """Ranges [first, last) of a text that windows of passages of smaller ids cover; they may overlap. A seed's occurrence is
    extended as far as passage and text agree; later seeds within the same run are not."""
    step, reach = (window + 1) // 2, {}
    length = window - step + 1
    for end, found in automaton.iter(text):
        if type(found) is tuple:
            if found[0] < own:
                yield end + 1 - window, end + 1
            continue
        at = end + 1 - length
        for rep, passage, place in found:
            if rep >= own or reach.get((id(passage), at - place), -1) > end:
                continue
            back = 0
            while back < at and back < place and text[at - back - 1] == passage[place - back - 1]:
                back += 1
            last = at + _run(text, at, passage, place)
            reach[id(passage), at - place] = last
            if last - at + back >= window:
                yield at - back, last


def _stream(window: int):
    """Spans [first, last) of words of the streamed texts that an earlier text's windows cover."""

    def run(table):
        passage = table["passage"].to_numpy()
        held, visits = table.filter(pa.array(passage)), table.filter(pa.array(~passage))
        rep, th, at = (visits[c].to_pylist() for c in ("rep", "th", "at"))
        words = [t.split(" ") for t in visits["text"].to_pylist()]
        spans: list[tuple[int, int, int]] = []
        for letters, automaton in _automata(list(zip(held["rep"].to_pylist(), held["text"].to_pylist())), window):
            letter = letters.get
            for own, text, start, parts in zip(rep, th, at, words):
                reach = -1
                for first, last in sorted(_located("".join([letter(w, "\0") for w in parts]), automaton, own, window)):
                    if first <= reach:
                        spans[-1] = (text, spans[-1][1], start + max(last, reach))
                    else:
                        spans.append((text, start + first, start + last))
                    reach = max(last, reach)
        columns = zip(*spans) if spans else ([], [], [])
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=SPANS)

    return run


def _finish(window: int):
    """Words, removed words and kept text of (doc_id, text, rep, first, last)."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                words = Words(part.column(1), NOT_SPACE, fold=False)
                ids, reps = (part.column(c).fill_null(np.iinfo(np.int64).min).to_numpy() for c in (0, 2))
                gone = np.zeros(len(words.start) + 1, np.int64)
                own = part.column(0).is_valid().to_numpy(zero_copy_only=False) & part.column(2).is_valid().to_numpy(zero_copy_only=False)
                for side, lists in ((1, part.column(3)), (-1, part.column(4))):
                    n = np.where(own & (ids == reps), lists.value_lengths().fill_null(0).to_numpy(), 0)
                    place = np.repeat(words.at[:-1], n) + lists.filter(pa.array(n > 0)).flatten().to_numpy()
                    np.add.at(gone, place, side)
                copy = np.flatnonzero(own & (ids > reps) & (words.counts >= window))  # all its windows start in the first copy
                np.add.at(gone, words.at[copy], 1)
                np.add.at(gone, words.at[copy + 1], -1)
                keep, n = np.cumsum(gone)[:-1] == 0, words.counts.astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(n - per_document(keep, words.at)), joined(words, keep)], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept are the words, joined by one space, that no repeated window covers. A window
    is repeated where its word sequence also starts in a document with a smaller id.

    1. Equal texts are one text, of the smallest id; copies with greater ids lose all windows. Texts are cut into pieces of
       PIECE windows, so that no later step holds a very long text or a crowd of copies.
    2. Each window is represented by its least phrase hash, the same wherever the window occurs; a fifth of all positions
       remain. Phrases of two texts at least recur; a sketch sized by their number holds them. It may let more pass, never
       less: beyond SKETCH_BITS / 4 phrases it lets nearly all pass, and more windows than need be are shuffled.
    3. Windows of such phrases are aggregated to the piece of smallest id that holds them: recurring windows. In a row they
       make passages, which that piece gives out word for word. Its hash deals it to a shard of SHARD_WINDOWS on average.
    4. A piece that holds a recurring window later on is sent to the shard of the window's passage: so each text is streamed
       through the automata of all shards that have anything in common with it, and no others.
    5. A shard's passages are compiled into automata whose letters are words, exactly. Their patterns are seeds, of which each
       window of a passage holds one; a seed found in a text streamed through is extended over all words that passage and
       text share. They find all occurrences; hashes decide nothing here. A shard that many texts meet (a very common
       passage) is dealt over tasks, each with the shard's automata and STREAM_BYTES of text.
    6. The spans found, merged by text, are taken out.

    Hashes are 64 bits of mixed words: a clash of two different recurring windows, of which n * n / 2**65 are expected among
    n, may hide the later one's first occurrence; it never removes a word.

    Null and empty texts have no words; null ids neither remove nor lose words; rows of one doc_id do not remove each
    other's words; an empty table gives none; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text", F.octet_length("text")))
    long_enough = F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * window - 1)
    reps = rows.where(long_enough).groupBy("th").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = materialize(reps.where("n > 1"), "copies")
    distinct = rows.where(long_enough).join(copies.select("th", "rep"), "th", "left").where("rep IS NULL OR rep = doc_id")
    pieces = materialize(distinct.select("th", F.col("doc_id").alias("rep"), "text").mapInArrow(_cut(window, PIECE), "piece long, th long, at long, rep long, text string"), "pieces")

    texts, schema = pieces.select("piece", "rep", "text"), "hash long, rep long, piece long"
    many = F.col("first") < F.col("last")
    phrases = texts.mapInArrow(_hashes(window, phrase, None), schema).groupBy("hash").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where(many)
    phrases = materialize(phrases.select("hash"), "phrases")
    bits = min(SKETCH_BITS, max(SKETCH_LEAST, 1 << (SKETCH_PER * phrases.count()).bit_length()))
    sketch = _sketch(phrases, bits)
    remove(phrases)
    pairs = texts.mapInArrow(_hashes(window, phrase, sketch), schema)
    firsts = pairs.groupBy("hash").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.min_by("piece", "rep").alias("owner")).where(many)
    firsts = materialize(firsts.select("hash", "first", "owner"), "windows")

    shards = firsts.count() // SHARD_WINDOWS + 1
    shard_of = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    visits = pairs.join(firsts, "hash").where("rep > first").select("piece", shard_of("owner").alias("shard")).distinct()
    known = visits.select("piece", "shard", F.lit(None).cast("long").alias("hash")).unionByName(firsts.select(F.col("owner").alias("piece"), F.lit(None).cast("int").alias("shard"), "hash"))
    size = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    group = lambda name: F.pmod(F.xxhash64("piece", F.lit(1)), F.lit(int(size // GROUP_BYTES) + 1)).alias(name)
    left, right = known.select(group("of_group"), "piece", "shard", "hash"), pieces.select(group("in_group"), "piece", "rep", "th", "at", shard_of("piece").alias("own"), "text")
    dealt = left.groupBy("of_group").cogroup(right.groupBy("in_group")).applyInArrow(_deal(window, phrase), "shard int, rep long, th long, at long, passage boolean, text string")
    dealt = materialize(dealt, "dealt")
    remove(firsts)
    remove(pieces)

    parts = dealt.where("NOT passage").groupBy("shard").agg((F.floor(F.sum(F.octet_length("text")) / STREAM_BYTES) + 1).cast("int").alias("parts"))
    spread = dealt.join(materialize(parts, "parts"), "shard")  # a row a shard
    part = F.when(F.col("passage"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("th", "at"), F.col("parts")).cast("int")))
    streamed = spread.withColumn("part", F.explode(part)).groupBy("shard", "part").applyInArrow(_stream(window), "th long, first long, last long")
    spans = materialize(streamed, "spans").groupBy("th").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))  # as many as a text's words
    marks = materialize(spans.join(copies, "th", "full"), "marks")
    remove(dealt)

    marked = heavy_split_join(rows, marks, "th", copies.select("th", "n"), rows.count())
    own = F.when(F.col("rep").isNotNull(), F.col("rep")).when(F.col("first").isNotNull(), F.col("doc_id"))
    return marked.select("doc_id", "text", own.alias("rep"), "first", "last").mapInArrow(_finish(window), "doc_id long, n_words long, n_removed long, kept string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_W = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
x AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM x JOIN f USING (g) WHERE first < doc_id),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT r, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE gone.p IS NULL) AS kept
      FROM p LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
