"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents, materialize
from tidemill.llm.features import DIGIT, LETTER, MARK, SYMBOL, Texts
from tidemill.llm.textvec import ALNUM, Words, per_document, slices

#: Labelled rows that the model is fitted on: those of the smallest hashes of doc_id.
FIT_ROWS = 12_000
#: Share of the toxic fitting rows that a lexicon entry occurs in at least, and its least log-odds.
SUPPORT, ODDS = 0.012, 2.0
#: Words between a lexicon entry and a second-person pronoun that count as near.
NEAR = 6
THRESHOLD = 0.7
#: Trees, their depth, learning rate, least hessian of a leaf, and candidate cuts of a feature.
TREES, DEPTH, RATE, LEAST, CUTS = 80, 3, 0.2, 1.0, 63
PRONOUNS = "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tus usted ustedes su vosotros vuestro".split()
#: Characters written for letters, as in "st0pid" or "tr@sh".
SPELLING = np.arange(256, dtype=np.uint8)
for _written, _meant in zip("0134578@$", "oieastbas"):
    SPELLING[ord(_written)] = ord(_meant)
NAMES = (
    "lexicon_words", "lexicon_density", "stem_words", "stem_density", "strongest", "sum_of_odds", "near_second_person", "pronoun_density",
    "obfuscated_hits", "mixed_words", "capital_words", "capitals", "punctuation", "exclamations", "symbols", "digits", "log_words",
)


def _stems(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first 4 bytes and the first 6 of each longer word, as numbers; 0 for shorter words."""
    data = np.append(words.data, np.zeros(8, np.uint8))
    folded = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint64)
    out = []
    for n in (4, 6):
        key = np.zeros(len(words.start), np.uint64)
        for j in range(n):
            key |= folded[words.start + j] << np.uint64(8 * j)
        out.append(np.where(words.end - words.start > n, key, np.uint64(0)))
    return tuple(out)


def _terms(column: pa.Array):
    """Alphanumeric words of the texts, and for each of three kinds (word, 4-byte stem, 6-byte stem) its key."""
    words = Words(column, ALNUM, fold=True)
    return words, [words.hashes(), *_stems(words)]


def _look_up(keys: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weight of each key in a sorted table; 0 if it isn't there."""
    known, weight = table
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, weight[at], 0.0)


def features(column: pa.Array, lexicon: list[tuple[np.ndarray, np.ndarray]], pronouns: np.ndarray) -> np.ndarray:
    words, keys = _terms(column)
    odds = [_look_up(k, t) for k, t in zip(keys, lexicon)]
    any_odds = np.maximum.reduce(odds)
    n, at = np.maximum(words.counts, 1), words.at
    exact, stem, hit = odds[0] > 0, (odds[1] > 0) | (odds[2] > 0), any_odds > 0
    strongest = np.zeros(words.n)
    np.maximum.at(strongest, words.doc(), any_odds)
    second = np.isin(keys[0], pronouns)
    total = np.concatenate([[0], np.cumsum(second)])
    first, last = np.repeat(at[:-1], words.counts), np.repeat(at[1:], words.counts)
    place = np.arange(len(second))
    near = hit & (total[np.minimum(place + NEAR + 1, last)] - total[np.maximum(place - NEAR, first)] > 0)
    respelled = Words(column, ALNUM, fold=True, spelling=SPELLING)
    hidden = per_document(_look_up(respelled.hashes(), lexicon[0]) > 0, respelled.at) - per_document(exact, at)
    t = Texts(column)
    letters, digits, symbols = t.in_word(LETTER), t.in_word(DIGIT), t.in_word(SYMBOL)
    upper = t.in_word(np.isin(np.arange(256), np.arange(0x41, 0x5B)))
    bang = np.zeros(256, bool)
    bang[0x21] = True
    per = lambda flag: per_document(flag, at)
    return np.stack(
        [
            np.log1p(per(exact)), 100 * per(exact) / n, np.log1p(per(stem)), 100 * per(stem) / n, strongest, np.log1p(per(np.rint(any_odds * 4096).astype(np.int64)) / 4096),
            np.log1p(per(near)), 100 * per(second) / n, np.log1p(np.maximum(hidden, 0)), t.of_words((letters > 0) & (digits + symbols > 0)), t.of_words((upper >= 2) & (upper == letters)),
            t.share(np.isin(np.arange(256), np.arange(0x41, 0x5B))), t.share(MARK), t.share(bang), t.share(SYMBOL), t.share(DIGIT), np.log1p(words.counts),
        ],
        axis=1,
    ).astype(np.float64)


def _distinct_terms(candidates: list[np.ndarray] | None):
    """(kind, key, n): in how many texts each term occurs; only the candidates, if given."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(0)):
                words, keys = _terms(batch.column(0).slice(a, b - a))
                doc = words.doc()
                for kind, key in enumerate(keys):
                    use = key != 0 if candidates is None else np.isin(key, candidates[kind])
                    pairs = np.unique(np.stack([key[use], doc[use].astype(np.uint64)]), axis=1)
                    found, n = np.unique(pairs[0], return_counts=True)
                    kinds = pa.array(np.full(len(found), kind, np.int32))
                    yield pa.RecordBatch.from_arrays([kinds, pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    return run


def _lexicon(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Terms of toxic rows (text, toxic) that are much rarer in others: sorted keys and log-odds by kind. Only terms with
    support reach the driver: those are fewer than the words of the toxic rows by that support."""
    toxic, clean = (rows.where(F.col("toxic") == v).select("text") for v in (1, 0))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    least = max(3, round(SUPPORT * n.get(1, 0)))
    schema, count = "kind int, key long, n long", F.sum("n").alias("n")
    often = toxic.mapInArrow(_distinct_terms(None), schema).groupBy("kind", "key").agg(count).where(F.col("n") >= least).toArrow()
    kind, key = often["kind"].to_numpy(), often["key"].to_numpy().view(np.uint64)
    seen = dict(zip(zip(kind.tolist(), key.tolist()), often["n"].to_pylist()))
    candidates = [np.sort(key[kind == k]) for k in range(3)]
    other = clean.mapInArrow(_distinct_terms(candidates), schema).groupBy("kind", "key").agg(count).toArrow()
    among = dict(zip(zip(other["kind"].to_pylist(), other["key"].to_numpy().view(np.uint64).tolist()), other["n"].to_pylist()))
    out = []
    for k in range(3):
        c = candidates[k]
        a = np.array([seen[k, x] for x in c.tolist()], float)
        b = np.array([among.get((k, x), 0) for x in c.tolist()], float)
        odds = np.log((a + 0.5) / (n.get(1, 0) + 1)) - np.log((b + 0.5) / (n.get(0, 0) + 1))
        out.append((c[odds >= ODDS], odds[odds >= ODDS]))
    return out


def grow(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Boosted trees for the logistic loss, by second-order gains over quantile cuts; complete trees of DEPTH levels."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)  # value > cut j: bin > j
    base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    score, feature, limit, value = np.full(len(y), base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node, split, where = np.zeros(len(y), np.int64), np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f, c in enumerate(cuts):
                m = len(c) + 1
                code = (node - first) * m + binned[:, f]
                hist = np.stack([np.bincount(code, w, minlength=width * m).reshape(width, m) for w in (g, h)])
                left = np.cumsum(hist, axis=2)[:, :, :-1]
                total = hist.sum(2, keepdims=True)
                right = total - left
                gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - total[0] ** 2 / (total[1] + 1)
                gain[(left[1] < LEAST) | (right[1] < LEAST)] = 0
                if m > 1:
                    j = gain.argmax(1)
                    top = gain[np.arange(width), j]
                    wins = top > best
                    best[wins] = top[wins]
                    split[first : first + width][wins] = f
                    where[first : first + width][wins] = c[j[wins]]
            node = 2 * node + 1 + (x[np.arange(len(x)), split[node]] > where[node])
        leaf = node - (2**DEPTH - 1)
        sums = np.stack([np.bincount(leaf, w, minlength=2**DEPTH) for w in (g, h)])
        step = -RATE * sums[0] / (sums[1] + 1)
        score += step[leaf]
        feature.append(split)
        limit.append(where)
        value.append(step)
    return {"base": np.array([base]), "feature": np.array(feature), "limit": np.array(limit), "value": np.array(value)}


def raw_scores(trees: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(x), trees["base"][0]), np.arange(len(x))
    for split, where, value in zip(trees["feature"], trees["limit"], trees["value"]):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, split[node]] > where[node])
        out += value[node - (2**DEPTH - 1)]
    return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y to raw (pool adjacent violators)."""
    values, inverse = np.unique(raw, return_inverse=True)
    blocks: list[list[float]] = []
    for x, total, n in zip(values, np.bincount(inverse, y), np.bincount(inverse)):
        blocks.append([total, n, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, _, x1 = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += n
            blocks[-1][3] = x1
    at = [b[i] for b in blocks for i in (2, 3)]
    return np.array(at), np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Isotonic probability; a hundredth of it follows the raw score, so that a plateau keeps its order."""
    p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
    return np.clip(0.99 * np.interp(raw, *knots) + 0.01 * p, 0, 1) if len(knots[0]) else p


def training_rows(doc_id: Column) -> Column:
    """Whether labels of a row may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from labels (doc_id, toxic) of training rows, FIT_ROWS of them at most: two thirds make the lexicon and
    the trees, the rest calibrates. Only ids, at most FIT_ROWS, are broadcast to the documents. Of several texts of one id the
    least one counts, so that rows repeating an id add nothing; a label given twice counts once, contradicting ones each."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & training_rows(F.col("doc_id")))
    ids = usable.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    ids = materialize(ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(FIT_ROWS), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).alias("part")
    one = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(one.select("text", "toxic", part), "training")
    lexicon = _lexicon(rows.where("part < 2"))
    pronouns = np.sort(Words(pa.array(PRONOUNS), ALNUM, fold=True).hashes())

    def measured(batches):
        for batch in batches:
            for a, b in slices(batch.column(0)):
                x = features(batch.column(0).slice(a, b - a), lexicon, pronouns)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], names=["x", "toxic", "part"])

    table = rows.select("text", "toxic", F.col("part").cast("int").alias("part")).mapInArrow(measured, "x array<double>, toxic int, part int").toArrow()
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)) if len(table) else np.zeros((0, len(NAMES)))
    y, fold = table["toxic"].to_numpy().astype(float), table["part"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # rows arrive in any order; sums of floats should not
    x, y, fold = x[order], y[order], fold[order]
    fit = fold < 2
    trees = grow(x[fit], y[fit]) if fit.any() else {"base": np.zeros(1), "feature": np.zeros((0, 7), int), "limit": np.zeros((0, 7)), "value": np.zeros((0, 8))}
    knots = isotonic(raw_scores(trees, x[~fit]), y[~fit]) if (~fit).any() else (np.zeros(0), np.zeros(0))
    return {"lexicon": lexicon, "pronouns": pronouns, "trees": trees, "knots": knots}


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each document: the probability that it is toxic, from its whole text alone.

    Features: words and stems of a lexicon learned from the training rows (count, density, odds), their nearness to
    second-person pronouns, obfuscated entries, and rates of capitals, punctuation, symbols and digits. Null and empty
    texts have no words and get the score of such. Null and repeated ids each get a row, equal texts equal scores wherever
    they stand; labels that contradict each other all count; without labels all scores are a half; an empty table gives none;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit_toxicity(rows, labels)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                x = features(batch.column(1).slice(a, b - a), model["lexicon"], model["pronouns"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(calibrated(raw_scores(model["trees"], x), model["knots"]))], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return scored.select("doc_id", (~training_rows(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
