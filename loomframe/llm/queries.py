"""Queries over the training-data tables, one for each operator, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import ann, exact_dedup, hilbert, html_extract, licenses, mixing, packing, simhash, toxicity, url_rules

#: Target shares of sources and size of the mix as a multiple of the corpus.
MIX_WEIGHTS, MIX_BUDGET, MIX_SEED = {"src0": 0.15, "src1": 0.10, "src2": 0.05}, 1.25, 7
#: A document is toxic from this score on.
TOXIC = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to the target shares, in their shuffled order."""
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, MIX_WEIGHTS, MIX_BUDGET, MIX_SEED)
    copy, key = (c for c in out.columns if c not in docs.columns)
    return out.select("doc_id", "source", "lang", F.col(copy).alias("mix_copy"), F.col(key).alias("mix_key"), "text")


def op2_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), limit=2048, end_id=1)


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    held = F.coalesce(toxicity.fold(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= TOXIC).cast("int").alias("predicted"), F.col("toxicity.n").alias("n_passages"))


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of pages that show a labelled document; its number ends the path's directory."""
    labels = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").groupBy("doc_id").agg(((F.min("quality") == 0) | (F.max("toxic") == 1)).alias("blocked"))
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", "://[^/]*/[^/]*/([0-9]{1,18})", 1).cast("long").alias("doc_id")).where("doc_id is not null")
    return pages.join(labels, "doc_id").select("url", "blocked")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.mine(labelled_urls(spark, sf_dir))
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents")).drop("row_id")


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.mark(table(spark, sf_dir, "documents"), words=4, radius=4)


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.shard(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mix_sources, op2_pack_binary, op3_toxic_segments, op4_url_rules, op5_license_scan, op6_nearest, op7_main_text, op8_exact_dedup, op9_simhash_groups, op10_hilbert_shards)
    return {f.__name__: f for f in found}


def _mix_sql() -> str:
    """Poisson draws by hashed uniform numbers, as SQL."""
    names = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in MIX_WEIGHTS.items())
    rest = 1.0 - sum(MIX_WEIGHTS.values())
    return f"""
WITH weights(bucket, share) AS (VALUES {names}),
sized AS (
  SELECT d.*, w.bucket, greatest(strlen(coalesce(text, '')), 1) AS bytes,
         coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name
  FROM documents d LEFT JOIN weights w ON coalesce(d.source, '') = w.bucket),
totals AS (SELECT bucket, sum(bytes)::BIGINT AS bytes FROM sized GROUP BY bucket),
shares AS (SELECT t.bucket, t.bytes, coalesce(w.share, {rest!r}::DOUBLE) AS share FROM totals t LEFT JOIN weights w ON t.bucket = w.bucket),
rates AS (
  SELECT bucket, {MIX_BUDGET}::DOUBLE * (share / (SELECT sum(share) FROM shares)) * (SELECT sum(bytes)::BIGINT FROM totals) / bytes AS rate FROM shares),
parts AS (SELECT bucket, CAST(greatest(0, ceil(rate / {mixing.MAX_RATE}::DOUBLE) - 1) AS INTEGER) AS more, rate - {mixing.MAX_RATE}::DOUBLE * greatest(0, ceil(rate / {mixing.MAX_RATE}::DOUBLE) - 1) AS rate FROM rates),
draws AS (
  SELECT s.name, s.bucket, p.rate, '{MIX_SEED}:' || s.name AS seed FROM sized s JOIN parts p ON s.bucket IS NOT DISTINCT FROM p.bucket
  UNION ALL SELECT s.name, s.bucket, {mixing.MAX_RATE}::DOUBLE, '{MIX_SEED}+' || j || ':' || s.name
  FROM sized s JOIN parts p ON s.bucket IS NOT DISTINCT FROM p.bucket, LATERAL (SELECT unnest(range(1, p.more + 1)) AS j)),
drawn AS (SELECT DISTINCT name, bucket, rate, seed, ('0x' || substr(md5(seed), 1, {mixing.DIGITS}))::BIGINT / {float(16**mixing.DIGITS)!r}::DOUBLE AS u FROM draws),
steps AS (SELECT rate, k, exp(-rate) * power(rate, k) / gamma(k + 1.0) AS p FROM (SELECT DISTINCT rate FROM drawn), range(0, 80) AS t(k)),
cdf AS (SELECT rate, k, sum(p) OVER (PARTITION BY rate ORDER BY k) AS f FROM steps),
numbers AS (SELECT name, bucket, sum((SELECT count(*) FROM cdf c WHERE c.rate = d.rate AND d.u >= c.f)) AS n FROM drawn d GROUP BY name, bucket),
counted AS (SELECT s.doc_id, s.source, s.lang, s.text, s.name, CAST(m.n AS BIGINT) AS n FROM sized s JOIN numbers m ON m.name = s.name AND m.bucket IS NOT DISTINCT FROM s.bucket)
SELECT doc_id, source, lang, CAST(copy AS INTEGER) AS mix_copy,
       md5('{MIX_SEED}/' || name || '/' || CAST(copy AS VARCHAR)) AS mix_key, text
FROM counted, range(0, counted.n) AS r(copy)"""


EXACT_SQL = r"""
WITH clean AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM clean WINDOW same AS (PARTITION BY body)"""


def _url_sql() -> str:
    """Itemsets of any length with their labels, grown token by token in the order of the tokens and counted by brute force."""
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    longest = sorted(url_rules.RULES, key=lambda r: -len(r[1]) - len(r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest) + " WHEN mined_rule IS NOT NULL THEN 'block' ELSE 'allow' END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    masked = lambda c: f"regexp_replace({lower(c)}, '[0-9]+', '9', 'g')"
    words = lambda prefix, c, by: f"list_transform(list_filter(string_split({c}, '{by}'), lambda x: x <> ''), lambda x: '{prefix}' || x)"
    return rf"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS rid, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT *, coalesce({lower("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
baskets AS (
  SELECT rid, url, list_distinct(list_concat(
    ['s:' || {lower("split_part(url, '://', 1)")}],
    {words("h:", masked("host"), ".")},
    {words("p:", masked("regexp_replace(path, '[.][^./]*$', '')"), "/")},
    CASE WHEN regexp_extract(path, '([.][^./]*)$', 1) <> '' THEN ['e:' || {masked("regexp_extract(path, '([.][^./]*)$', 1)")}] ELSE [] END,
    {words("q:", masked("regexp_replace(regexp_extract(rest, '[?]([^#]*)', 1), '=[^&]*', '', 'g')"), "&")},
    CASE WHEN instr(rest, '#') > 0 THEN ['f:'] ELSE [] END)) AS items
  FROM split WHERE rest IS NOT NULL),
tok AS (SELECT rid, url, unnest(items) AS token FROM baskets),
flags AS (SELECT doc_id, (min(quality) = 0 OR max(toxic) = 1) AS blocked FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
marked AS (
  SELECT b.rid, f.blocked FROM baskets b JOIN flags f
  ON f.doc_id = TRY_CAST(regexp_extract(b.url, '://[^/]*/[^/]*/([0-9]{{1,18}})', 1) AS BIGINT)),
total AS (SELECT count(*) AS n FROM marked),
least AS (SELECT greatest(ceil({url_rules.MIN_SUPPORT!r}::DOUBLE * n), {url_rules.MIN_URLS}) AS hits FROM total),
base AS (SELECT count(*) FILTER (WHERE blocked) / count(*)::DOUBLE AS rate FROM marked),
lt AS (SELECT m.rid, m.blocked, t.token FROM marked m JOIN tok t ON t.rid = m.rid),
one AS (SELECT token, count(*) AS n, count(*) FILTER (WHERE blocked) AS hit FROM lt GROUP BY token),
good1 AS (SELECT [token] AS items, hit / n::DOUBLE AS confidence FROM one, least, base WHERE hit >= hits AND hit / n::DOUBLE >= {url_rules.MIN_CONFIDENCE!r}::DOUBLE AND hit / n::DOUBLE > rate),
open_tok AS (SELECT lt.rid, lt.token FROM lt JOIN one USING (token), least WHERE blocked AND hit >= hits AND token NOT IN (SELECT items[1] FROM good1)),
grown AS (
  SELECT rid, [token] AS items FROM open_tok
  UNION ALL SELECT rid, items FROM (SELECT g.rid, list_append(g.items, t.token) AS items, count(*) OVER (PARTITION BY list_append(g.items, t.token)) AS hit
    FROM grown g JOIN open_tok t ON t.rid = g.rid AND t.token > g.items[-1]) WHERE hit >= (SELECT hits FROM least)),
cand AS (SELECT items, count(*) AS hit FROM grown WHERE len(items) > 1 GROUP BY items),
several AS (SELECT c.items, any_value(c.hit) / count(*)::DOUBLE AS confidence FROM cand c JOIN (SELECT b.items FROM marked m JOIN baskets b ON b.rid = m.rid) x ON list_has_all(x.items, c.items) GROUP BY c.items),
good2 AS (SELECT items, confidence FROM several, base WHERE confidence >= {url_rules.MIN_CONFIDENCE!r}::DOUBLE AND confidence > rate),
good AS (SELECT * FROM good1 UNION ALL SELECT * FROM good2 g WHERE NOT EXISTS (SELECT 1 FROM good2 h WHERE len(h.items) < len(g.items) AND list_has_all(g.items, h.items))),
hits AS (SELECT b.rid, g.confidence, array_to_string(g.items, ' ') AS rule_id FROM baskets b JOIN good g ON list_has_all(b.items, g.items)),
best AS (SELECT rid, max({{'c': confidence, 'r': rule_id}}).r AS mined_rule FROM hits GROUP BY rid),
joined AS (SELECT s.*, b.mined_rule FROM split s LEFT JOIN best b ON s.rid = b.rid)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, mined_rule FROM joined"""


def _license_sql() -> str:
    """Phrases by list comparison; the best window of every template by counting words from each start."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in licenses.PHRASES.items())
    rows = []
    for i, (text, label) in enumerate(licenses.template_words().items()):
        own = sorted(set(text.split()))
        rows.append(f"({i}, '{label}', {quoted(own)}, {len(own)}, {math.ceil(licenses.THRESHOLD * len(own) - 1e-9)}, {math.ceil(licenses.WIDTH * len(text.split()))})")
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
phrases(label, own) AS (VALUES {phrases}),
templates(tid, label, own, n, need, width) AS (VALUES {", ".join(rows)}),
u AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM texts),
base AS (SELECT u.rid, u.i, p.label FROM u JOIN phrases p ON u.word = p.own[1] JOIN texts t ON t.rid = u.rid WHERE t.words[u.i + 1 : u.i + len(p.own)] = p.own),
members AS (SELECT t.tid, unnest(t.own) AS word FROM templates t),
held AS (SELECT u.rid, u.i, m.tid, u.word FROM u JOIN members m ON u.word = m.word),
likely AS (SELECT h.rid, h.tid FROM held h GROUP BY h.rid, h.tid HAVING count(DISTINCT h.word) >= (SELECT need FROM templates t WHERE t.tid = h.tid)),
near AS (SELECT h.* FROM held h SEMI JOIN likely USING (rid, tid)),
windows AS (SELECT a.rid, a.tid, a.i, count(DISTINCT b.word) AS c FROM near a JOIN templates t ON t.tid = a.tid JOIN near b ON b.rid = a.rid AND b.tid = a.tid AND b.i BETWEEN a.i AND a.i + t.width - 1 GROUP BY a.rid, a.tid, a.i),
found AS (SELECT w.rid, t.label, max(w.c / t.n::DOUBLE) AS share FROM windows w JOIN templates t ON t.tid = w.tid WHERE w.c >= t.need GROUP BY w.rid, t.label),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS names FROM base GROUP BY rid),
f AS (SELECT rid, list(label) AS names, max(share) AS share FROM found GROUP BY rid)
SELECT t.doc_id, len(t.words) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word, coalesce(array_to_string(b.names, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.names, []), coalesce(f.names, [])))), ','), '') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(f.share, 0.0::DOUBLE) END AS score
FROM texts t LEFT JOIN b ON b.rid = t.rid LEFT JOIN f ON f.rid = t.rid"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _mix_sql(), "op4_url_rules": _url_sql(), "op5_license_scan": _license_sql(), "op8_exact_dedup": EXACT_SQL}
