"""The registered queries of the pipeline operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, langid, mixing, packing, prefixtrie, simhash, suffixdedup, tokencount, toxicity, urlfilter, vectorcodes, warc, webp

URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Hosts that the site list blocks, with the hosts below them.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: Besides these, a quarter of the corpus's hosts is listed, so that the cascade has keys to tell apart at any size.
LISTED_BELOW = "4"
LISTED_HOSTS = tuple(f"{name}.example.{top}" for name in LISTED_NAMES for top in ("com", "net", "org"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i+m-1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT r, m, i, array_to_string(w[i:i+m-1], ' ') AS win
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM lowered, lengths WHERE len(w) >= m)
), hits AS (SELECT r, i, places.m, item_id FROM places JOIN windows ON places.win = windows.win AND places.m = windows.m),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hits) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark, read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS keep FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM g"""


def op3_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(spark, read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(spark, read(spark, sf_dir, "documents"))


def op5_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.report(spark, read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(spark, read(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(spark, read(spark, sf_dir, "documents"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    host = urlfilter.url_host(F.col("url"))
    listed = pages.select(host.alias("key")).filter((F.col("key") != "") & (F.md5("key") < LISTED_BELOW)).distinct()
    listed = listed.union(spark.createDataFrame([(x,) for x in LISTED_HOSTS], "key string"))
    out = urlfilter.judge(spark, pages, listed, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def _op9_sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    named = ", ".join(f"('{h}')" for h in LISTED_HOSTS)
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), listed AS (
  SELECT host AS key FROM p WHERE host <> '' AND md5(host) < '{LISTED_BELOW}' UNION SELECT key FROM (VALUES {named}) v(key)
), bad AS (SELECT DISTINCT host FROM p, listed WHERE host = key OR ends_with(host, '.' || key))
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)} END AS rule,
  CASE {" ".join(f"WHEN {fits(h, p)} THEN '{w}'" for w, h, p in rules)} WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM p"""


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_features(spark, read(spark, sf_dir, "documents"))


def op11_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.report(spark, read(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(concat(length(coalesce(role, '')), ':', role, text)) AS tie
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, tie) AS turns FROM t GROUP BY c),
bits AS (SELECT n, list_reduce(list_prepend(n, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(n)),
crc AS (SELECT map(list(n), list(v)) AS m FROM bits),
heads AS (
  SELECT c, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a >> 8, m[xor(a & 255, b)])), 4294967295) % 6 AS h FROM own, crc
), built AS (
  SELECT a.c, list_concat(CASE WHEN b.c IS NULL THEN [] ELSE b.turns[1:a.h] END, a.turns[a.h + 1:]) AS seq FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 100
), starts AS MATERIALIZED (SELECT c, d, seq[1:d] AS beginning, len(seq) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE length(seq[d].text) END AS chars FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM built)),
node AS MATERIALIZED (SELECT beginning, d, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c) AS ids FROM starts GROUP BY beginning, d),
owner AS MATERIALIZED (SELECT c, starts.d, conv_id FROM starts JOIN node USING (d, beginning)),
child AS (SELECT o.conv_id, o.d, count(*) AS n_children FROM node n JOIN owner o ON o.c = n.conv_id AND o.d = n.d - 1 GROUP BY ALL),
full_node AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN child USING (conv_id, d)),
sums AS (
  SELECT o.conv_id, o.d, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM full_node n JOIN owner o ON o.c = n.conv_id AND o.d <= n.d GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_node n JOIN sums USING (conv_id, d) LEFT JOIN owner p ON p.c = n.conv_id AND p.d = n.d - 1"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(spark, read(spark, sf_dir, "documents"))


def op13_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.report(spark, read(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    nearest = "min((list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e))::BIGINT * 256 + entry)"
    steps = []
    for k in range(5):
        steps.append(f"n{k} AS MATERIALIZED (SELECT r, x.p, any_value(x) AS x, {nearest} AS best FROM x JOIN b{k} ON x.p = b{k}.p GROUP BY r, x.p)")
        if k < 4:
            steps.append(f"""
s{k} AS (SELECT p, best % 256 AS entry, i, floor(sum(x[i]) / count(*)) AS c FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM n{k}) GROUP BY ALL),
u{k} AS (SELECT p, entry, list(c ORDER BY i) AS e FROM s{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b{k}.p, b{k}.entry, coalesce(u{k}.e, b{k}.e) AS e FROM b{k} LEFT JOIN u{k} USING (p, entry))""")
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), x AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM k, range(4) t(p)
), b0 AS (SELECT p, r - 1 AS entry, x AS e FROM x WHERE r <= 256), {", ".join(steps)},
codes AS (SELECT r, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM n4 GROUP BY r),
books AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, entry, i)) AS sha FROM (SELECT p, entry, unnest(e) AS c, unnest(range(len(e))) AS i FROM b4))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM k JOIN codes USING (r), books"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_warc": OP2_SQL, "op9_urlfilter": _op9_sql(), "op11_prefixtrie": OP11_SQL, "op13_vectorcodes": _op13_sql()}
