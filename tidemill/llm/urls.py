"""URL filter by host rules and a path-template tree, in DataFrame operations alone (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents, heavy_split_join, materialize

#: (verdict, rule): a rule is a host, which covers its subdomains, and the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Levels of OP7_SQL's tree, whose deeper segments share one node "**"; the operator goes on to the last segment.
DEPTH = 4
#: A node's children are variable if there are so many and none has over so many times their mean number of pages.
CHILDREN, STANDS_OUT = 16, 4.0
#: Stands for any digits, and for any segment of a template. No path holds it, as a query starts there.
ANY = "?"
#: Branches whose bad share differs by less than sqrt(Z2) standard errors from that of their siblings merge. Among the n
#: children of a variable node some differ by chance, the most by about sqrt(2 ln n) errors, so the square's bound is 2 ln n wider.
Z2 = 4.0
#: Weight of the overall bad share in a template's, and the share from which a template is rejected.
PRIOR, REJECT = 10.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. rules is a short list, part of the query."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def templates(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, n, labelled, bad) with template: the tree's generalised path of each shape, to its last segment.

    Level by level from the root, a child becomes a wildcard, and its branch merges with other such, if its labelled pages do
    not differ from its siblings' by more than chance (a two-proportion z test). A variable segment, one of many children of
    which none stands out, is given the wider bound of as many comparisons. Both tests are of shares, so that a site with
    more pages of the same kinds has the same tree, but for what more labels tell apart. Counts of a node are aggregated; no
    task holds a node's children.

    Levels at which a node has one child decide nothing. Each round therefore takes each subtree to its own next branching,
    past what its least and largest path have in common, and leaves alone those with one path. There are as many rounds as
    branchings on one way from the root at most, however long the paths are.
    """
    segments = F.slice(F.split("shape", "/", -1), 2, 1 << 30)
    todo, done = shapes.withColumn("segments", segments).withColumn("prefix", F.lit("")).withColumn("level", F.lit(0)), None
    rounds = 0
    while True:
        least, largest = F.min("segments"), F.max("segments")
        differ = F.array_position(F.zip_with(least, largest, lambda a, b: a.eqNullSafe(b)), False).cast("int") - 1
        ways = todo.groupBy("host", "prefix", "level").agg(differ.alias("branching"))
        at = todo.join(ways, ["host", "prefix", "level"]).withColumn("prefix", F.array_join(F.slice("segments", F.lit(1), F.greatest("branching", F.lit(0))), "/"))
        at = materialize(at.withColumn("segment", F.get("segments", F.col("branching"))), "tree")
        ended = at.where("branching < 0 OR segment IS NULL").select(*shapes.columns, "segments")
        done = ended if done is None else done.unionByName(ended)
        rounds += 1
        if rounds % 16 == 0:  # keeps the plan short
            done = materialize(done, "done")
        at = at.where("branching >= 0 AND segment IS NOT NULL").drop("level").withColumnRenamed("branching", "level")
        if at.isEmpty():
            break
        child = at.groupBy("host", "level", "prefix", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        node = child.groupBy("host", "level", "prefix").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"), F.max("n").alias("most"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        l, b, big_l, big_b = (F.col(c).cast("double") for c in ("labelled", "bad", "all_labelled", "all_bad"))
        gap = b * (big_l - l) - (big_b - b) * l
        variable = (F.col("children") >= CHILDREN) & (F.col("most") * F.col("children") <= STANDS_OUT * F.col("all_n"))
        bound = F.lit(Z2) + F.when(variable, 2 * F.log(F.col("children").cast("double"))).otherwise(F.lit(0.0))
        spread = l * (big_l - l) * big_b * (big_l - big_b)
        similar = (F.col("children") > 1) & ((spread == 0) | (gap * gap * big_l < bound * spread))
        merged = child.join(node, ["host", "level", "prefix"]).where(similar & (F.col("segment") != ANY)).select("host", "level", "prefix", "segment", F.lit(True).alias("merged"))
        wild = F.concat(F.slice("segments", F.lit(1), F.col("level")), F.array(F.lit(ANY)), F.slice("segments", F.col("level") + 2, F.lit(1 << 30)))
        new = at.join(merged, ["host", "level", "prefix", "segment"], "left").withColumn("segments", F.when(F.col("merged"), wild).otherwise(F.col("segments"))).withColumn("level", F.col("level") + 1)
        todo = materialize(new.withColumn("prefix", F.array_join(F.slice("segments", F.lit(1), F.col("level")), "/")).select(*shapes.columns, "segments", "prefix", "level"), "tree")
    done = materialize(done, "done")
    return done.withColumn("template", F.concat(F.when(F.size("segments") > 0, F.lit("/")).otherwise(F.lit("")), F.array_join("segments", "/"))).drop("segments")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, template, verdict) for each page: block or allow by the longest fitting rule, else block
    if the smoothed bad share of the labelled pages of its template is REJECT at least.

    labels has (number, bad): verdicts on pages by the last number in their path, if of 18 digits at most. In a path's shape digits are wildcards,
    so shapes are few; they are counted first, with a partial sum in each task, and the tree works on those counts. Back
    on the pages, shapes with many pages are joined by broadcast (1000 of them at most), others by a shuffle.

    A null url, or one without "://", has an empty host and path, and no number. Null ids and repeated pages each get a
    row. Labels that are null or match no page change nothing; several labels of one number all count. No labelled page:
    nothing is rejected but by rule. An empty table gives none; other columns are ignored.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("shape", F.regexp_replace("path", "[0-9]+", ANY)).withColumn("key", F.concat_ws("\n", "host", "shape"))
    number = F.regexp_extract("path", r"(?s)([0-9]+)[^0-9]*$", 1)
    counted = rows.groupBy("host", "shape", "key", F.when(F.length(number).between(1, 18), number.cast("long")).alias("number")).agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "counted")
    judged = labels.where("number IS NOT NULL AND bad IS NOT NULL").groupBy("number").agg(F.count(F.lit(1)).alias("given"), F.sum(F.col("bad").cast("long")).alias("bad"))
    known = counted.where("number IS NOT NULL").join(judged, "number").groupBy("key").agg(F.sum(F.col("n") * F.col("given")).alias("labelled"), F.sum(F.col("n") * F.col("bad")).alias("bad"))
    shapes = counted.groupBy("key", "host", "shape").agg(F.sum("n").alias("n")).join(known, "key", "left").na.fill(0, ["labelled", "bad"])
    tree = templates(materialize(shapes, "shapes"))
    overall = tree.agg(F.sum("bad"), F.sum("labelled"), F.sum("n")).first()
    prior = (overall[0] or 0) / max(overall[1] or 0, 1)
    share = tree.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l"))
    share = share.select("host", "template", ((F.col("b") + F.lit(PRIOR * prior)) / (F.col("l") + F.lit(PRIOR))).alias("purity"))
    judgement = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    table = materialize(tree.join(share, ["host", "template"]).select("key", "template", judgement.alias("learned")), "templates")
    joined = heavy_split_join(rows, table, "key", tree.select("key", "n"), overall[2] or 0)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return joined.select("page_id", "host", "path", rule.alias("rule"), "template", F.coalesce(verdict, "learned").alias("verdict"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' numbers are those of the documents they show; a document of low quality or a toxic one is bad."""
    labels = documents(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("number"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(documents(spark, sf_dir, "pages"), labels)


def _level_sql(k: int) -> str:
    prefix = f"array_to_string(s[1:{k}], '/')" if k else "''"
    return f"""
c{k} AS (SELECT host, {prefix} AS prefix, s[{k + 1}] AS seg, sum(n) AS n, CAST(sum(l) AS DOUBLE) AS l, CAST(sum(b) AS DOUBLE) AS b FROM t{k} WHERE len(s) > {k} GROUP BY ALL),
p{k} AS (SELECT host, prefix, count(*) AS kids, sum(n) AS an, max(n) AS mn, sum(l) AS al, sum(b) AS ab FROM c{k} GROUP BY ALL),
m{k} AS (SELECT host, prefix, seg FROM c{k} JOIN p{k} USING (host, prefix) WHERE seg <> '{ANY}' AND kids > 1 AND (l * (al - l) * ab * (al - ab) = 0
   OR (b * (al - l) - (ab - b) * l) * (b * (al - l) - (ab - b) * l) * al
      < ({Z2} + CASE WHEN kids >= {CHILDREN} AND mn * kids <= {STANDS_OUT} * an THEN 2 * ln(CAST(kids AS DOUBLE)) ELSE 0 END) * (l * (al - l) * ab * (al - ab)))),
t{k + 1} AS (SELECT t.host, shape, n, l, b, CASE WHEN m.seg IS NOT NULL THEN list_concat(s[1:{k}], ['{ANY}'], s[{k + 2}:]) ELSE s END AS s
  FROM t{k} AS t LEFT JOIN m{k} AS m ON m.host = t.host AND m.prefix = {prefix} AND m.seg = s[{k + 1}]),"""


_RULE_SQL = "CASE " + " ".join(
    f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{{{i}}}'"
    for i, (_, t) in sorted(enumerate(RULES), key=lambda x: -len(x[1][1]))
) + " END"
OP7_SQL = f"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS x FROM pages),
r AS (SELECT page_id, translate(x.host, '{UPPER}', '{LOWER}') AS host, x.path AS path, regexp_replace(x.path, '[0-9]+', '{ANY}', 'g') AS shape,
      CASE WHEN length(regexp_extract(x.path, '(?s)([0-9]+)[^0-9]*$', 1)) BETWEEN 1 AND 18
           THEN CAST(regexp_extract(x.path, '(?s)([0-9]+)[^0-9]*$', 1) AS BIGINT) END AS number FROM u),
j AS (SELECT doc_id AS number, count(*) AS given, sum(CAST(quality = 0 OR toxic = 1 AS BIGINT)) AS bad FROM labels
      WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
z AS (SELECT host, shape, count(*) AS n, coalesce(sum(given), 0) AS l, coalesce(sum(bad), 0) AS b FROM r LEFT JOIN j USING (number) GROUP BY ALL),
t0 AS (SELECT host, shape, n, l, b, CASE WHEN len(w) > {DEPTH} THEN list_append(w[1:{DEPTH}], '**') ELSE w END AS s
       FROM (SELECT *, string_split(shape, '/')[2:] AS w FROM z)),{"".join(_level_sql(k) for k in range(DEPTH + 1))}
g AS (SELECT host, shape, l, b, CASE WHEN len(s) > 0 THEN '/' || array_to_string(s, '/') ELSE '' END AS template FROM t{DEPTH + 1}),
o AS (SELECT sum(b) / greatest(sum(l), 1) AS prior FROM g),
v AS (SELECT host, template, CASE WHEN (sum(b) + {PRIOR} * any_value(prior)) / (sum(l) + {PRIOR}) >= {REJECT} THEN 'block' ELSE 'allow' END AS learned FROM g, o GROUP BY ALL)
SELECT page_id, host, path, {_RULE_SQL.format(*[t for _, t in RULES])} AS rule, template, coalesce({_RULE_SQL.format(*[w for w, _ in RULES])}, learned) AS verdict
FROM r JOIN g USING (host, shape) JOIN v USING (host, template)
"""
