"""Queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.llm import clusters, decontaminate, extract, language, packing, quality, ranked, sharding, simhash, substring, tokenstore, topk, warc
from gridmark.llm.frames import remainder, stored, table
from gridmark.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_substring_dedup", r"""
WITH w AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
win AS MATERIALIZED (SELECT r, i, array_to_string(ws[i + 1:i + 35], ' ') AS t FROM (SELECT r, ws, unnest(range(0, len(ws) - 34)) AS i FROM w)),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win WHERE t IN (SELECT t FROM win GROUP BY t HAVING count(*) > 1)),
word AS (SELECT r, unnest(range(len(ws))) AS p, unnest(ws) AS x FROM w),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN hit USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "repeats.n_words", "repeats.n_removed", "repeats.kept_sha256")


@query("op6_decontaminate", r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
item AS (SELECT DISTINCT item_id, m, array_to_string(ws[i + 1:i + m], ' ') AS t FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(0, len(ws) - least(10, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
win AS (SELECT r, m, i, array_to_string(ws[i + 1:i + m], ' ') AS t FROM (SELECT r, ws, m, unnest(range(0, len(ws) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM item))),
hit AS MATERIALIZED (SELECT r, i, win.m, item_id FROM win JOIN item ON win.m = item.m AND win.t = item.t),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) WHERE id IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN ids USING (r)
""")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids")


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).withColumn("law", F.lit("key"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packing with the public byte-level vocabulary; ids are those of its definition's plain call, added tokens recognised."""
    import public_tokenizers as public

    return packing.pack(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, added=True)


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op1_topk", """
WITH v AS MATERIALIZED (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
t AS MATERIALIZED (SELECT vec_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM t q JOIN t c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc.write_packages(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return warc.read_records(written, text=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                                         number("refers_to").alias("refers_to"))


@query("op3_extract")
def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    found = language.learn_and_predict(docs, held_out, keep=["doc_id"])
    return found.select("doc_id", stored(held_out).alias("held_out"), "lang_pred", "score", "accepted")


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 0
    found = quality.learn_and_score(docs, labels, held_out, keep=["doc_id"])
    return found.select("doc_id", stored(held_out).alias("held_out"), "score", "predicted")


def _cluster_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Lloyd's rounds unrolled: each one assigns by an ordered pick over all centroids and takes floors of the means."""
    square = f"CAST(list_sum([(w[i] - v[i]) * (w[i] - v[i]) FOR i IN range(1, {dim + 1})]) AS BIGINT)"
    ctes = [f"""x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS w FROM embeddings
  WHERE len(embedding) = {dim} AND len([1 FOR c IN embedding IF c IS NULL OR isnan(c) OR isinf(c)]) = 0)""",
            f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, w AS v FROM x QUALIFY c < {k})"]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': {square}, 'c': c}}) AS m FROM x, c{i} GROUP BY r)")
        if i < rounds:
            ctes.append(f"""s{i} AS (SELECT c, i, sum(p) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(w) AS p, unnest(range({dim})) AS i FROM a{i} JOIN x USING (r)) GROUP BY c, i),
n{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS u FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(u, v) AS v FROM c{i} LEFT JOIN n{i} USING (c))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(v, ',')) AS centroid_sha256
FROM a{rounds} JOIN x USING (r) JOIN c{rounds} ON c{rounds}.c = m.c"""


@query("op13_clusters", _cluster_sql())
def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_token_store")
def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    files = tokenstore.write_tokens(table(spark, sf_dir, "documents"), shared_folder(spark, "tokens"), public.path("byte_bpe_50k.json"),
                                    public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    return tokenstore.read_tokens(files)


@query("op11_ranked_search", r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS MATERIALIZED (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(ws) AS t FROM b) GROUP BY ALL),
tf AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n_all, CAST(sum(len(ws)) AS BIGINT) AS l_all FROM d WHERE len(ws) > 0),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, n_all),
m AS (SELECT r, doc_id, 25 + (75 * len(ws) * n_all) // l_all AS m FROM d, s WHERE len(ws) > 0),
score AS (SELECT item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 10
""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
