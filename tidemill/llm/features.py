"""Dense features of whole texts, for the labellers of operator 9 and the trees of operator 10: no loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemill.llm.textvec import ALNUM, NOT_SPACE, Words, per_document

UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LETTER = UPPER.copy()
LETTER[0x61:0x7B] = LETTER[0x80:] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
#: ASCII marks that prose has few of.
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~"]] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in "!?.,;:"]] = True


class Texts:
    """Words (white-space separated, A-Z folded in the hashes) and byte sums of some texts."""

    def __init__(self, column: pa.Array):
        self.words = Words(column, NOT_SPACE, fold=True)
        self.hashes = self.words.hashes()
        self.doc = self.words.doc()
        self.n = np.maximum(self.words.counts, 1)
        self.size = np.maximum(np.diff(self.words.offsets), 1)

    def share(self, table: np.ndarray) -> np.ndarray:
        """Share of a text's bytes in a table."""
        return per_document(table[self.words.data], self.words.offsets) / self.size

    def in_word(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each word in a table."""
        total = np.zeros(len(self.words.data) + 1, np.int64)
        np.cumsum(table[self.words.data], out=total[1:])
        return total[self.words.end] - total[self.words.start]

    def of_words(self, flag: np.ndarray) -> np.ndarray:
        """Share of a text's words that are flagged."""
        return per_document(flag, self.words.at) / self.n

    def distinct(self, values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each document, and how often its most frequent one occurs."""
        if not len(values):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        bits = np.uint64(16 if n <= 1 << 16 else int(n - 1).bit_length())  # the same in all slices: their rows are few
        key = np.sort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (values >> bits))  # a document's values by their first 48 bits
        d = (key >> (np.uint64(64) - bits)).astype(np.int64)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        runs = np.diff(np.append(starts, len(key)))
        most = np.zeros(n, np.int64)
        np.maximum.at(most, d[starts], runs)
        return np.bincount(d[starts], minlength=n), most

    def lines(self, column: pa.Array) -> np.ndarray:
        """Share of a text's non-empty lines that repeat another of its lines."""
        not_newline = np.ones(256, bool)
        not_newline[0x0A] = False
        lines = Words(column, not_newline, fold=False)
        kinds, _ = self.distinct(lines.hashes(), lines.doc(), lines.n)
        return np.where(lines.counts > 0, 1 - kinds / np.maximum(lines.counts, 1), 0.0)


#: Names of quality()'s columns.
QUALITY = ("words", "symbols", "marked_words", "capital_words", "top_word", "distinct_words", "repeated_words", "repeated_lines", "digits", "mean_word", "bare_marks", "letters")


def quality(column: pa.Array) -> np.ndarray:
    t = Texts(column)
    w = t.words
    kinds, most = t.distinct(t.hashes, t.doc, w.n)
    length = w.end - w.start
    letters, upper, alnum = t.in_word(LETTER), t.in_word(UPPER), t.in_word(ALNUM)
    again = np.zeros(len(t.hashes), bool)
    again[1:] = (t.hashes[1:] == t.hashes[:-1]) & (t.doc[1:] == t.doc[:-1])
    return np.stack(
        [
            w.counts, t.share(SYMBOL), t.of_words(t.in_word(SYMBOL) > 0), t.of_words((upper >= 2) & (upper == letters)), most / t.n, kinds / t.n,
            t.of_words(again), t.lines(column), t.share(DIGIT), per_document(length, w.at) / t.n, t.of_words(alnum == 0), t.share(LETTER),
        ],
        axis=1,
    ).astype(np.float64)
