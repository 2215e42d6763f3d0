"""Secret scans through a trigram inverted index, in DataFrame operations alone (operator 2)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents, materialize

try:
    from re import _constants as sre, _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has min_length code points at least; others are dropped."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


#: The last two patterns say {16,} and {24,} instead of dropping shorter matches: their matches are whole runs either way.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: doc_ids of one posting list: 2**SHARD_BITS, a bound on its length.
SHARD_BITS = 12
#: Strings of a literal run that are multiplied out; beyond them, the run is cut.
MAX_STRINGS = 64
#: Elements of an array that a fold makes grow.
BLOCK = 64
ANY: frozenset = frozenset([frozenset()])


def _simple(query: frozenset) -> frozenset:
    """A | (A & B) is A."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: frozenset, b: frozenset) -> frozenset:
    return _simple(frozenset(x | y for x in a for y in b)) if len(a) * len(b) <= MAX_STRINGS**2 else min(a, b, key=len)


def _spelled(strings: set[str]) -> frozenset:
    return _simple(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _node(op, arg) -> tuple[set[str] | None, frozenset]:
    """(all strings the node matches, lower-case, if they are few; what any text with a match must hold)."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len({chr(c).lower() for _, c in arg}) <= 4:
        return {chr(c).lower() for _, c in arg}, ANY
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*(strings for strings, _ in parts)), ANY
        return None, _simple(frozenset().union(*(_both(_spelled(s), q) if s is not None else q for s, q in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, part = arg
        strings, query = _sequence(part)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, ANY
        if least == 0:
            return None, ANY
        return (strings, query) if (least, most) == (1, 1) else (None, _both(query, _spelled(strings) if strings is not None else ANY))
    if op is sre.AT:
        return {""}, ANY
    return None, ANY


def _sequence(nodes) -> tuple[set[str] | None, frozenset]:
    strings, query, whole = {""}, ANY, True
    for op, arg in nodes:
        s, q = _node(op, arg)
        if s is not None and len(strings) * len(s) <= MAX_STRINGS:
            strings = {a + b for a in strings for b in s}
            continue
        whole = False
        query = _both(_both(query, _spelled(strings)), q)
        strings = {""}
        if s is not None:
            strings = s if len(s) <= MAX_STRINGS else {""}
    return (strings, ANY) if whole else (None, _both(query, _spelled(strings)))


def trigram_query(pattern: str) -> list[list[str]] | None:
    """The trigrams that a text with a match must hold, as alternatives of conjunctions, over lower-cased text; None if
    the pattern has a match without mandatory trigrams, so that every text must be scanned."""
    strings, query = _sequence(parser.parse(pattern))
    if strings is not None:
        query = _spelled(strings)
    return None if frozenset() in query else sorted(sorted(c) for c in query)


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Posting lists (trigram, shard, ids) of the given trigrams in lower-cased texts. A shard is a range of 2**SHARD_BITS
    ids, so that no list exceeds it, however common the trigram. Texts without an id are not in it."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    pairs = rows.select("doc_id", F.explode(held).alias("trigram"))
    return pairs.groupBy("trigram", F.shiftright("doc_id", SHARD_BITS).alias("shard")).agg(F.collect_set("doc_id").alias("ids"))


def _marked(bit: int):
    return lambda d: F.struct(d.alias("doc_id"), F.lit(bit).alias("rule"))


def candidates(index: DataFrame, queries: list[list[list[str]] | None]) -> DataFrame:
    """(doc_id, rules): for each document that satisfies a query, a bit for each such query. Postings of a conjunction are
    intersected, those of alternatives united, shard by shard."""
    trigrams = sorted({t for q in queries if q for c in q for t in c})
    lists = index.groupBy("shard").agg(*[F.coalesce(F.flatten(F.collect_list(F.when(F.col("trigram") == t, F.col("ids")))), F.array().cast("array<long>")).alias(f"p{i}") for i, t in enumerate(trigrams)])
    posting = {t: F.col(f"p{i}") for i, t in enumerate(trigrams)}
    found = [
        F.transform(reduce(F.array_union, [reduce(F.array_intersect, [posting[t] for t in c]) for c in q]), _marked(1 << k))
        for k, q in enumerate(queries)
        if q
    ]
    return lists.select(F.explode(F.concat(*found)).alias("x")).groupBy("x.doc_id").agg(F.bit_or("x.rule").alias("rules"))


def _pieces(text: Column, rule: Rule) -> tuple[Column, Column]:
    """What stands before each match, the match and its group, as structs; what follows the last match."""
    before, pattern = F.split(text, rule.pattern, -1), F.lit(rule.pattern)
    whole, value = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    return F.arrays_zip(F.slice(before, 1, F.size(whole)).alias("before"), whole.alias("whole"), value.alias("value")), F.element_at(before, -1)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being evaluated once: within a lambda an expression is evaluated at each element, a variable is not."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(lengths: Column, levels: int = 3) -> Column:
    """The sum of what stands before each element. An array that grows is copied at each step, so those here end at BLOCK elements,
    and what stands before each block is found in the same way."""
    none = F.array().cast("array<int>")

    def step(a, x):
        return F.struct((a["at"] + x).alias("at"), F.concat(a["sums"], F.array(a["at"])).alias("sums"))

    def within(part):
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("sums")), step)

    def shifted(blocks):
        before = _running(F.transform(blocks, lambda x: x["at"]), levels - 1)
        return F.flatten(F.zip_with(blocks, before, lambda x, s: F.transform(x["sums"], lambda v: v + s)))

    def by_blocks(whole):
        starts = F.sequence(F.lit(0), F.greatest(F.size(whole) - 1, F.lit(0)), F.lit(BLOCK))
        return _bound(F.transform(starts, lambda i: within(F.slice(whole, i + 1, F.lit(BLOCK)))), shifted)

    return within(lengths)["sums"] if levels == 1 else _bound(lengths, by_blocks)


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, kind, end) in code points of the rule's matches."""

    def span(x, at):
        start = at + F.length(x["before"])
        return F.when(F.length(x["value"]) >= rule.min_length, F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.length(x["whole"])).alias("end")))

    def placed(pieces):
        at = _running(F.transform(pieces, lambda x: F.length(x["before"]) + F.length(x["whole"])))
        return F.filter(F.zip_with(pieces, at, span), lambda x: x.isNotNull())

    return _bound(_pieces(text, rule)[0], placed)


def _redacted(text: Column, rule: Rule, mask: str) -> Column:
    pieces, rest = _pieces(text, rule)
    masked = F.transform(pieces, lambda x: F.concat(x["before"], F.when(F.length(x["value"]) >= rule.min_length, F.lit(mask)).otherwise(x["whole"])))
    return F.concat(F.array_join(masked, ""), rest)


def _with_rules(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> tuple[DataFrame, list[Column]]:
    """docs with a column of bits of the rules to verify, under a name of its own; for each rule, whether to verify it."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries if q for c in q for t in c})
    bits, key = "_rules", "_candidate"
    while bits in docs.columns or key in docs.columns:
        bits, key = bits + "_", key + "_"
    if trigrams:
        index = materialize(trigram_index(docs, trigrams, id_col, text_col), "trigrams")
        found = materialize(candidates(index, queries).select(F.col("doc_id").alias(key), F.col("rules").alias(bits)), "candidates")
        docs = docs.join(found, docs[id_col].cast("long") == found[key], "left")  # broadcast only if Catalyst sees a small table
        docs = docs.withColumn(bits, F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(F.coalesce(bits, F.lit(0)))).drop(key)
    else:
        docs = docs.withColumn(bits, F.lit(0))
    guards = [F.col(bits).bitwiseAND(F.lit(1 << k)) != 0 if q else F.col(text_col).rlike(r.pattern) for k, (r, q) in enumerate(zip(rules, queries))]
    return docs, guards


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) for each document: found are the spans (start, kind, end) of secrets, in code points, by start and
    then by the rule's place in rules.

    Each rule's pattern gives a Boolean query of trigrams; the index holds the postings of just the trigrams some rule
    asks for; a rule's matches are verified in the texts its query selects, and rules without mandatory trigrams scan all
    texts. The index may select too much (it folds case), never too little, as each text with a match holds the trigrams.

    Null and empty texts hold nothing; texts with a null id are not in the index and are scanned by all rules; rows that
    repeat a doc_id each get a row, and are scanned if any of them is selected; an empty table gives none; other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, guards = _with_rules(rows, rules, "doc_id", "text")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = [F.when(g, _spans(F.col("text"), r, k)).otherwise(empty) for k, (r, g) in enumerate(zip(rules, guards))]
    return rows.select("doc_id", F.array_sort(F.concat(*[F.coalesce(f, empty) for f in found])).alias("found"))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, mask: str = "[secret]") -> DataFrame:
    """docs with each secret in text replaced by mask, rule by rule, and n_chars, if there is one, counted anew."""
    rows, guards = _with_rules(docs, rules, "doc_id", "text")
    text = F.col("text")
    for rule, guard in zip(rules, guards):
        rows = rows.withColumn("text", F.when(guard, _redacted(text, rule, mask)).otherwise(text))
    kinds = dict(docs.dtypes)
    if "n_chars" in kinds:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(kinds["n_chars"]))
    return rows.select(docs.columns)


def _of_kind(number: int):
    return lambda x: x["kind"] == number


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    kinds = F.array(*[F.lit(r.kind) for r in BASE_RULES])
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _kind_sql(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT r, {number} AS k, '{kind}' AS kind, i,
  CAST(list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda p: length(p))), 0) AS BIGINT) AS s, length(whole[i]) AS n
FROM (SELECT r, parts, whole, value, unnest(range(1, len(whole) + 1)) AS i FROM (
  SELECT r, string_split_regex(text, '{pattern}') AS parts, regexp_extract_all(text, '{pattern}') AS whole, regexp_extract_all(text, '{pattern}', {group}) AS value FROM d))
WHERE length(value[i]) >= {least}"""


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_kind_sql(k, r.kind, r.pattern if k == 0 else {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}[r.kind], r.group, r.min_length) for k, r in enumerate(BASE_RULES))}),
g AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
      string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(s + n AS VARCHAR), ',' ORDER BY s, k) AS spans FROM m GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
