"""Cleaning of messages and pages (A16, A17, A19, F24, I04, I08 to I21, I23, I24, O39): documents, turns and pages stand for channel posts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.plans.dual import duck, dual, run
from tidemill.registry import query, table

_NUMBERS = ("3.70", "-358,7", "1,234", "1.234,5", "1,234.5", "0,123", "12,345,678", "7.", "-", "abc", "", "+5", "1.2.3", "1,23", ".5")
_SAID = "SELECT event_id, CASE event_id % 15 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_NUMBERS)) + " END AS said FROM {events}"


@query("i08_locale_numbers", duck(f"""WITH e AS ({_SAID}), s AS (SELECT event_id, rtrim(trim(said), '.,') AS s FROM e),
  p AS (SELECT event_id, CASE WHEN contains(s, ',') AND contains(s, '.') THEN CASE WHEN length(s) - instr(reverse(s), ',') > length(s) - instr(reverse(s), '.') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '') END
    WHEN regexp_full_match(s, '[-+]?[1-9][0-9]?[0-9]?(,[0-9][0-9][0-9])+') THEN replace(s, ',', '') ELSE replace(s, ',', '.') END AS p FROM s)
  SELECT event_id, CASE WHEN regexp_full_match(p, '[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN CAST(p AS DOUBLE) END AS x FROM p"""))
def locale_numbers(spark, sf_dir):
    return run(spark, sf_dir, _SAID).select("event_id", tx.locale_number(F.col("said")).alias("x"))


_VIEWS = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN '1.2K' WHEN 1 THEN '3M' WHEN 2 THEN '415' WHEN 3 THEN ' 10.55k' WHEN 4 THEN 'K' WHEN 5 THEN '' ELSE '2.5m ' END AS v FROM {events}"


@query("i20_views", duck(f"""WITH v AS (SELECT event_id, upper(trim(v)) AS s FROM ({_VIEWS}) AS z) SELECT event_id, CASE WHEN regexp_full_match(s, '[0-9]+([.][0-9]+)?K') THEN CAST(round(CAST(s[:-2] AS DOUBLE) * 1000) AS BIGINT)
  WHEN regexp_full_match(s, '[0-9]+([.][0-9]+)?M') THEN CAST(round(CAST(s[:-2] AS DOUBLE) * 1000000) AS BIGINT) WHEN regexp_full_match(s, '[0-9]+([.][0-9]+)?') THEN CAST(round(CAST(s AS DOUBLE)) AS BIGINT) END AS views FROM v"""))
def views(spark, sf_dir):
    return run(spark, sf_dir, _VIEWS).select("event_id", tx.counted(F.col("v")).alias("views"))


dual("i22_json", "SELECT event_id, CAST(@json(props, 'k') AS BIGINT) * 2 AS k FROM {events}")


@query("i09_normal_text", duck("SELECT doc_id, sha256(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g'), '([0-9])[.,]\\s*\\n\\s*([0-9]{3})', '\\1.\\2', 'g')) AS h FROM {documents} WHERE text IS NOT NULL".replace("{200B}", "<200B>").replace("{200D}", "<200D>").replace("{2060}", "<2060>").replace("{FEFF}", "<FEFF>").replace("{3}", "<3>")).replace("<", "{").replace(">", "}"))
def normal_text(spark, sf_dir):
    """Composed characters (Arrow batches, as no SQL function composes), no zero-width ones, broken numbers joined."""

    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: unicodedata.normalize("NFC", s))

    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.sha2(tx.joined_numbers(nfc("text")), 256).alias("h"))


@query("i10_flat", "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B50}\\x{FE0F}]+', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^[ \\-–:/|]+|[ \\-–:/|]+$', '', 'g')) AS h FROM documents")
def flat_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.flat(F.coalesce("text", F.lit(""))), 256).alias("h"))


_FORMATS = [("headline", r"^\s*#"), ("list", r"^\s*[*\-]"), ("quote", r"^\s*>"), ("number", r"^\s*[0-9]")]


@query("i11_formats", "SELECT doc_id, CASE WHEN regexp_matches(t, '^#') THEN 'headline' WHEN regexp_matches(t, '^[*-]') THEN 'list' WHEN starts_with(t, '>') THEN 'quote' WHEN regexp_matches(t, '^[0-9]') THEN 'number' ELSE 'prose' END AS format FROM (SELECT doc_id, ltrim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t FROM documents)")
def formats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_listed(F.coalesce("text", F.lit("")), _FORMATS, F.lit("prose")).alias("format"))


#: Posts of several items, each with its time, made from events.
_POSTS = "SELECT event_id, ts, 'intro ' || event_type || chr(10) || '* 09:15: first' || chr(10) || CASE WHEN event_id % 3 = 0 THEN '  23:59 late' || chr(10) || 'goes on' ELSE 'no time here 12:30' END || CASE WHEN event_id % 4 = 0 THEN chr(10) || '- 7:05 last' ELSE '' END AS post FROM {events}"


@query("i12_items", duck(f"""SELECT event_id, k - 1 AS item, told, CAST((CAST(extract(hour FROM ts) AS BIGINT) * 60 + CAST(extract(minute FROM ts) AS BIGINT) + 420 - told + 2880) % 1440 AS BIGINT) AS delay FROM (
  SELECT event_id, ts, unnest(CASE WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN [1, 2, 3, 4] WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN [1, 2, 3] ELSE [1, 2] END) AS k,
    unnest(CASE WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN [NULL, 555, 1439, 425] WHEN event_id % 3 = 0 THEN [NULL, 555, 1439] WHEN event_id % 4 = 0 THEN [NULL, 555, 425] ELSE [NULL, 555] END) AS told FROM {{events}}) AS z"""))
def items(spark, sf_dir):
    """A post's items, the time told in each (I12), and how long before the post, local time of a zone seven hours ahead."""
    posts = run(spark, sf_dir, _POSTS)
    rows = posts.select("event_id", "ts", F.posexplode(tx.items(F.col("post"))).alias("item", "body"))
    rows = rows.withColumn("told", tx.minute_of(F.col("body")))
    return rows.select("event_id", F.col("item").cast("long").alias("item"), "told", tx.delay_minutes(F.col("ts").cast("timestamp"), F.col("told"), "Asia/Ho_Chi_Minh").cast("long").alias("delay"))


_RELEASES = "SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'US CPI Act: ' || CAST(event_id % 90 AS {text}) || ',5% Pre: 3.1% Exp: -0,2' WHEN 1 THEN 'EU PMI index Act: 51.3 Pre: - Exp: 50' WHEN 2 THEN 'US payrolls Act: 1,234 Pre: 987' ELSE 'nothing to see' END AS body FROM {events}"
_KEYS = [("cpi", r"\bCPI\b"), ("nfp", "payrolls"), ("pmi", r"\bPMI\b")]


@query("i13_releases", duck(_RELEASES.replace("{text}", "VARCHAR")).join(("WITH b AS (", """), x AS (SELECT event_id, body, trim(regexp_extract(body, '^(.*?) *Act:', 1)) AS name, regexp_extract(body, 'Act: *([-+]?[0-9.,]+)', 1) AS a, regexp_extract(body, 'Exp: *([-+]?[0-9.,]+)', 1) AS e, regexp_extract(body, 'Pre: *([-+]?[0-9.,]+)', 1) AS p FROM b WHERE contains(body, 'Act:')),
  n AS (SELECT *, CASE WHEN a = '1,234' THEN 1234.0 WHEN a <> '' THEN CAST(replace(a, ',', '.') AS DOUBLE) END AS act, CASE WHEN e <> '' THEN CAST(replace(e, ',', '.') AS DOUBLE) END AS exp, CASE WHEN p <> '' THEN CAST(replace(p, ',', '.') AS DOUBLE) END AS pre FROM x)
  SELECT event_id, name, act, exp, pre, round(act - exp, 6) AS surprise, name[1:2] AS country, CASE WHEN contains(name, 'CPI') THEN 'US:cpi' WHEN contains(name, 'payrolls') THEN 'US:nfp' ELSE name[1:2] || ':' || lower(name)[1:25] END AS key FROM n""")))
def releases(spark, sf_dir):
    """Figures of a release out of its text (I13), their surprise and key."""
    rows = run(spark, sf_dir, _RELEASES.replace("{text}", "STRING")).where("contains(body, 'Act:')")
    part = lambda name: F.nullif(F.regexp_extract("body", rf"{name}:\s*([-+]?[0-9.,]+)", 1), F.lit(""))
    rows = rows.select("event_id", F.trim(F.regexp_extract("body", r"^(.*?)\s*Act:", 1)).alias("name"), *[tx.locale_number(part(p)).alias(p.lower()) for p in ("Act", "Exp", "Pre")])
    country = F.nullif(F.regexp_extract("name", r"(?<!\w)(US|EU)(?!\w)", 1), F.lit("")).alias("country")
    rows = rows.select("*", country)
    key = F.when(F.col("country") == "US", tx.first_listed(F.col("name"), _KEYS))
    key = F.when(key.isNotNull(), F.concat(F.lit("US:"), key)).otherwise(F.concat_ws(":", F.coalesce("country", F.lit("?")), F.substring(F.lower("name"), 1, 25)))
    return rows.select("event_id", "name", "act", "exp", "pre", F.round(F.col("act") - F.col("exp"), 6).alias("surprise"), "country", key.alias("key"))


_TOPICS = [("code", r"(?i)\bpassword|secret|token\b"), ("link", r"https?://"), ("mail", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), ("money", r"[$€]|\bUSD\b"), ("shout", r"!!")]


@query("i14_topics", """WITH f AS (SELECT doc_id, text, lang, CAST(regexp_matches(text, '(?i)\\bpassword|secret|token\\b') AS INTEGER) AS code, CAST(contains(text, 'http://') OR contains(text, 'https://') AS INTEGER) AS link,
    CAST(regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS INTEGER) AS mail, CAST(contains(text, '$') OR contains(text, '€') OR regexp_matches(text, '\\bUSD\\b') AS INTEGER) AS money, CAST(contains(text, '!!') AS INTEGER) AS shout FROM documents)
  SELECT doc_id, code + link + mail + money + shout AS n_topics, CASE WHEN length(text) < 20 THEN 'short' WHEN code = 1 THEN 'code' WHEN shout = 1 AND mail = 0 THEN 'shout' ELSE '' END AS dropped, CASE WHEN code = 1 THEN 'code' WHEN link = 1 THEN 'link' WHEN mail = 1 THEN 'mail' WHEN money = 1 THEN 'money' WHEN shout = 1 THEN 'shout' END AS first FROM f""")
def topics(spark, sf_dir):
    """Topics of a text by patterns (I14), why it is dropped in order of priority (I15), and the first listed topic."""
    rows = table(spark, sf_dir, "documents").withColumn("found", tx.flags(F.col("text"), _TOPICS))
    has = lambda t: F.array_contains("found", t)
    dropped = F.when(F.length("text") < 20, "short").when(has("code"), "code").when(has("shout") & ~has("mail"), "shout").otherwise("")
    return rows.select("doc_id", F.size("found").alias("n_topics"), dropped.alias("dropped"), F.get("found", F.lit(0)).alias("first"))


@query("i21_urls", "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), 'https?://[^\\s)\\]>\"]+')) AS n, regexp_extract(coalesce(text, ''), 'https?://[^\\s)\\]>\"]+') AS first FROM documents")
def urls(spark, sf_dir):
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r'https?://[^\s)\]>"]+'), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first"))


dual("i04_rounding", "SELECT event_id, round(value, 1) AS one, CAST(floor(value * 10 + 0.5) AS BIGINT) AS tenths FROM {events}")
dual("i23_time_keys", "SELECT event_id, year(ts) * 10 + quarter(ts) AS quarter_key, year(ts) * 100 + month(ts) AS month_key, @epoch(ts) * 1000 AS ms FROM {events}")


@query("i24_durations", "SELECT event_id, CASE WHEN s >= 86400 THEN CAST(s // 86400 AS VARCHAR) || 'd ' || CAST(s // 3600 % 24 AS VARCHAR) || 'h' WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || 'h ' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || 'm' ELSE CAST(s // 60 AS VARCHAR) || 'm' END AS d FROM (SELECT event_id, CAST(floor(value * 900) AS BIGINT) AS s FROM events)")
def durations(spark, sf_dir):
    return run(spark, sf_dir, "SELECT event_id, CAST(floor(value * 900) AS BIGINT) AS s FROM {events}").select("event_id", tx.duration(F.col("s")).alias("d"))


@query("a16_newest_collected", "SELECT conv_id, arg_max(text, (turn, md5(text))) AS text, max(turn) AS turn FROM conversations GROUP BY conv_id")
def newest_collected(spark, sf_dir):
    """Of what was collected of one message the newest."""
    newest = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", F.md5("text"))).alias("text"), F.max("turn").alias("turn"))
    return newest


@query("a17_page_text", """SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a [^>]*href="')) AS links, len(regexp_extract_all(html, '(?i)<img')) AS images,
  length(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')) AS text_length FROM pages""")
def page_text(spark, sf_dir):
    """Title, links, images and text of a page, by patterns."""
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    bare = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), count('(?i)<a [^>]*href="').alias("links"), count("(?i)<img").alias("images"), F.length(bare).cast("long").alias("text_length"))


dual("a19_item_load", "SELECT doc_id, length(coalesce(text, '')) AS n, coalesce(lang, '') AS lang FROM {documents}")
dual("o39_message_summary", "SELECT lang, count(*) AS n, round(avg(CASE WHEN length(text) > 0 THEN 1.0 ELSE 0.0 END), 6) AS text_share, round(avg(CAST(n_chars AS DOUBLE)), 4) AS mean_length, max(n_chars) AS longest FROM {documents} GROUP BY lang")
