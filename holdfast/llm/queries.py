"""The operators over their whole tables, and the same results in SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import attention_lm, doubling, filter_audit, group_join, language, main_text, mixing, quality_rules, ring, shallot, simhash, suffix_dedup, winnowing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark, sf_dir):
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op2_suffix_arrays(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_attention_scores(spark, sf_dir):
    return attention_lm.score_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return language.predict_language(table(spark, sf_dir, "documents"))


def op6_benchmark_winnowing(spark, sf_dir):
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_level_doubling(spark, sf_dir):
    return doubling.remove_repeats(table(spark, sf_dir, "documents"))


def op8_ring_shards(spark, sf_dir):
    return ring.bounded_shards(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark, sf_dir):
    found = group_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op10_source_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_shallot_clusters(spark, sf_dir):
    return shallot.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_simhash_variants(spark, sf_dir):
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_suffix_arrays": op2_suffix_arrays,
    "op3_quality_rules": op3_quality_rules,
    "op4_attention_scores": op4_attention_scores,
    "op5_language_id": op5_language_id,
    "op6_benchmark_winnowing": op6_benchmark_winnowing,
    "op7_level_doubling": op7_level_doubling,
    "op8_ring_shards": op8_ring_shards,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_source_mixing": op10_source_mixing,
    "op11_shallot_clusters": op11_shallot_clusters,
    "op12_simhash_variants": op12_simhash_variants,
    "op13_filter_audit": op13_filter_audit,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"



def _kmeans_sql(rounds: int = 10, k: int = 8) -> str:
    """Rounds of assignment and floor of the mean, each a common table of its own."""
    steps = [
        f"""v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INT) AS cluster, v AS c FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        near = "list_sum(list_transform(range(1, 65), lambda j: (v[j] - c[j]) * (v[j] - c[j])))"
        steps.append(f"d{r} AS (SELECT i, cluster, CAST({near} AS BIGINT) AS d FROM v, c{r})")
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, min(d) AS distance, arg_min(cluster, [d, cluster]) AS cluster FROM d{r} GROUP BY i)")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT cluster, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM
(SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{r} JOIN v USING (i)) GROUP BY cluster, j),
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (i) JOIN c{rounds} USING (cluster)"""


ORACLES = {
    "op11_shallot_clusters": _kmeans_sql(),
    "op6_benchmark_winnowing": f"""WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS span FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, span, array_to_string(w[i:i + span - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - span + 2)) AS i FROM bs)),
sp AS (SELECT DISTINCT span FROM bw),
dw AS (SELECT doc_id, span, i, array_to_string(w[i:i + span - 1], ' ') AS win
  FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, sp WHERE len(w) >= span)),
m AS (SELECT doc_id, span, i, item_id FROM dw JOIN bw USING (span, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op7_level_doubling": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
g AS (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN f USING (h) WHERE doc_id > least),
r AS (SELECT DISTINCT doc_id, p FROM g),
k AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS kept FROM
  (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN r USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op9_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)""",
    "op13_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
  [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM w LEFT JOIN m USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT DISTINCT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS own,
  list_transform(range(1, step), lambda i: instr('ABCDE', filter_order[i])) AS before
  FROM (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o)),
r AS (SELECT part, filter_order, step, own, n, good, bad, fails[own] AS failing, len(list_filter(before, lambda i: fails[i])) > 0 AS gone,
  len(list_filter(fails, lambda x: x)) AS many FROM c, s),
a AS (SELECT part, filter_order, step, own,
  CAST(coalesce(sum(n) FILTER (WHERE NOT failing AND NOT gone), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE failing AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE failing AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE failing AND many = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE failing AND NOT gone), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(bad) FILTER (WHERE failing AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a""",
}
