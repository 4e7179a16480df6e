"""The registered queries of the package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellscape.llm import decontaminate, embeddings, html_extract, licenses, mixing, ngram_join, pii, quality, resample, toxicity, url_filter, vector_codes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_ngram_jaccard", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS sh FROM w),
c AS (SELECT sh, len(sh) AS n, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS x FROM c WHERE n > 0),
p AS (SELECT a.rep AS u, b.rep AS v FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT rep AS node, rep AS top FROM c WHERE n > 0 UNION SELECT r.node, p.v FROM r JOIN p ON p.u = r.top),
m AS (SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.top, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.sh) > 0 AND list_sort(s.sh) = c.sh LEFT JOIN m ON m.node = c.rep
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


@query("op9_mixing", r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY skey),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1] AS weight, 2 * words AS most FROM s),
l AS (SELECT *, row_number() OVER o AS place, (1.5::DOUBLE * CAST(sum(words) OVER () AS BIGINT)
        - coalesce(CAST(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
        / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
      FROM w WINDOW o AS (ORDER BY most / weight, skey)),
f AS (SELECT arg_min(level, place) AS level FROM l WHERE level * weight <= most),
t AS (SELECT skey, words, least(CAST(most AS DOUBLE), f.level * weight) AS target FROM l, f),
p AS (SELECT d.doc_id, d.size, t.words, t.target,
        coalesce(CAST(sum(d.size) OVER (PARTITION BY skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead
      FROM d JOIN t USING (skey))
SELECT doc_id, size, words AS source_size, target,
  CAST(CASE WHEN words = 0 THEN 0 ELSE floor(target)::BIGINT // words * size
    + least(greatest(floor(target)::BIGINT % words - ahead, 0), size) END AS BIGINT) AS taken
FROM p
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op6_warc", r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          CAST((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark), least=0)
    return warc.read_records(index, with_payload=False).drop("url")


@query("op8_pii")  # the trees' extra spans have no SQL; tests compare the base with brute force
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.fit(docs)))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op7_licenses", licenses.sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents"))


@query("op1_html")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op10_embeddings", """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM e WHERE list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS top FROM embeddings UNION SELECT r.node, l.w FROM r JOIN l ON l.u = r.top),
c AS (SELECT node, min(top) AS top FROM r GROUP BY node), d AS (SELECT u, count(*) AS k FROM l GROUP BY u)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, c.top AS component_id, vec_id = c.top AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN d ON d.u = vec_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_vector_codes", vector_codes.sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


@query("op12_resample", r"""
WITH words AS (
  SELECT 0 AS side, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS MATERIALIZED (SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM words),
f AS MATERIALIZED (SELECT side, rid, x, count(*) AS k FROM (SELECT side, rid, unnest(ws) AS x FROM w) GROUP BY ALL),
steps AS (SELECT list(c ORDER BY i) AS tbl FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
h AS (SELECT x, hex(encode(x)) AS digits FROM (SELECT DISTINCT x FROM f)),
b AS MATERIALIZED (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(digits) // 2), lambda i:
        CAST((position(digits[2 * i + 1] IN '0123456789ABCDEF') - 1) * 16 + position(digits[2 * i + 2] IN '0123456789ABCDEF') - 1 AS BIGINT))),
      lambda c, y: xor(c >> 8, tbl[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, steps),
n AS (SELECT bucket, CAST(coalesce(sum(k) FILTER (side = 0), 0) AS BIGINT) AS s, CAST(coalesce(sum(k) FILTER (side = 1), 0) AS BIGINT) AS t
      FROM f JOIN b USING (x) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000::DOUBLE * ln((t + 1)::DOUBLE * (CAST(sum(s) OVER () AS BIGINT) + 10000)::DOUBLE
        / ((s + 1)::DOUBLE * (CAST(sum(t) OVER () AS BIGINT) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
m AS (SELECT rid, CAST(sum(k * gain) AS BIGINT) AS total FROM f JOIN b USING (x) JOIN g USING (bucket) WHERE side = 0 GROUP BY rid),
d AS (SELECT doc_id, rid, CAST(len(ws) AS BIGINT) AS n_features,
        CASE WHEN len(ws) = 0 THEN 0 ELSE (total - (total % len(ws) + len(ws)) % len(ws)) // len(ws) END AS weight,
        CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS u
      FROM w LEFT JOIN m USING (rid) WHERE side = 0),
s AS (SELECT *, CAST(weight AS BIGINT) + CAST(floor(-1000::DOUBLE * ln(-ln((u + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, rid) AS rank, count(*) OVER () AS n FROM s WHERE n_features >= 20)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM s LEFT JOIN r USING (rid)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LISTED = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]


@query("op13_url_filter", r"""
WITH l(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
a AS (SELECT row_number() OVER () AS id, page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS pos FROM pages),
r AS (SELECT *, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM a),
u AS (SELECT id, page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM r),
d AS MATERIALIZED (SELECT id, page_id, host, path, list_distinct(list_concat(
        list_transform(list_filter(list_transform(range(1, 6), lambda i: array_to_string(string_split(host, '.')[-i:], '.')), lambda x: x <> ''), lambda x: 'host=' || x),
        list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path=' || x),
        list_transform(list_filter([regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)], lambda x: x <> ''), lambda x: 'ext=' || x),
        list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^[^=]*', 0)), lambda x: x <> ''), lambda x: 'query=' || x))) AS ts FROM u),
b AS MATERIALIZED (SELECT d.id, arg_max(struct_pack(rule := l.host || l.path, verdict := l.verdict), length(l.host || l.path)) AS m FROM d JOIN l
      ON (d.host = l.host OR ends_with(d.host, '.' || l.host)) AND starts_with(d.path, l.path) GROUP BY d.id),
t AS MATERIALIZED (SELECT b.id, b.m.verdict = 'block' AS bad, d.ts FROM b JOIN d USING (id)),
n AS (SELECT count(*) AS n, count(*) FILTER (bad) AS nb, CAST(ceil(0.005::DOUBLE * count(*)) AS BIGINT) AS least FROM t),
x AS MATERIALIZED (SELECT id, bad, unnest(ts) AS token FROM t),
k AS (SELECT token, abs(count(*) FILTER (bad) * any_value(n.n) - count(*) * any_value(nb)) AS tells FROM x, n GROUP BY token HAVING count(*) >= any_value(least)),
i AS (SELECT id, bad, list_sort(list(token ORDER BY tells DESC, token)[1:8]) AS ts FROM x JOIN k USING (token) GROUP BY id, bad),
c AS (SELECT bad, unnest(list_concat(list_transform(ts, lambda p: [p]),
        flatten(list_transform(range(1, len(ts) + 1), lambda p: list_transform(range(p + 1, len(ts) + 1), lambda q: [ts[p], ts[q]]))),
        flatten(flatten(list_transform(range(1, len(ts) + 1), lambda p: list_transform(range(p + 1, len(ts) + 1), lambda q:
          list_transform(range(q + 1, len(ts) + 1), lambda o: [ts[p], ts[q], ts[o]]))))))) AS needs FROM i),
g AS (SELECT needs, count(*) AS k, count(*) FILTER (bad) AS kb FROM c GROUP BY needs),
v AS MATERIALIZED (SELECT needs, verdict, hits / k::DOUBLE AS confidence, hits FROM (
        SELECT needs, k, kb AS hits, 'block' AS verdict FROM g UNION ALL SELECT needs, k, k - kb, 'allow' FROM g), n
      WHERE hits >= least AND hits / k::DOUBLE >= 0.9),
f AS (SELECT d.id, max(struct_pack(c := v.confidence, s := v.hits, z := -len(needs), r := array_to_string(needs, ' '), verdict := v.verdict)) AS m
      FROM d JOIN v ON list_has_all(d.ts, v.needs) WHERE d.id NOT IN (SELECT id FROM b) GROUP BY d.id)
SELECT page_id, host, path, b.m.rule AS rule, coalesce(b.m.verdict, f.m.verdict, 'allow') AS verdict, f.m.r AS mined
FROM d LEFT JOIN b USING (id) LEFT JOIN f USING (id)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.rule_list(spark, LISTED))
