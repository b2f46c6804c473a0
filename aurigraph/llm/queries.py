"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, cohorts, decontaminate, htmltext, jpeg, langid, mixing, nndescent, pii, quality, sharding, simhash
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) AS fingerprint", "component_id")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(table(spark, sf_dir, "documents")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT r, item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM sized)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT g.r, g.k, g.p, x.item_id FROM grams g JOIN windows x ON g.s = x.s AND g.k = x.k),
words AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r),
owners AS (SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(owners.n, 0)::BIGINT AS n_items,
  sha256(coalesce(owners.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN owners USING (r)
""".replace("\\\\", "\\")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jpeg.media_features(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixture(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "size", "source_size", "round(target, 6) AS target", "size * copies AS taken")


#: Sources in the order of ceiling over weight: one is at its ceiling if that is below the level which those before leave.
_OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight FROM s),
o AS (SELECT *, 3.0::DOUBLE * source_size AS ceiling, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS k FROM w),
c AS (SELECT *, sum(ceiling) OVER (ORDER BY k) - ceiling AS held, sum(weight) OVER () - (sum(weight) OVER (ORDER BY k) - weight) AS spread, sum(source_size) OVER ()::DOUBLE AS whole FROM o),
f AS (SELECT *, weight * ((whole - held) / spread) > ceiling AS is_full FROM c),
l AS (SELECT (any_value(whole) - coalesce(sum(ceiling) FILTER (WHERE is_full), 0)) / sum(weight) FILTER (WHERE NOT is_full) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN ceiling ELSE weight * level END AS target FROM f, l),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, d.size > 0 AND d.size * LARGE >= t.source_size AS is_large, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST(('0x' || substr(sha256('SEED:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::UBIGINT AS DOUBLE) / 281474976710656.0 AS draw,
  CAST(('0x' || substr(sha256('SEED:source:' || coalesce(d.source, '')), 1, 12))::UBIGINT AS DOUBLE) / 281474976710656.0 AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, dense_rank() OVER (PARTITION BY source, is_large ORDER BY size, draw, doc_id NULLS LAST) AS k FROM r),
e AS (SELECT *, CASE WHEN is_large THEN floor(k * (rate - floor(rate)) + start) - floor((k - 1) * (rate - floor(rate)) + start) WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS extra FROM n)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (floor(rate) + extra))::BIGINT AS taken FROM e
""".replace("SEED", str(mixing.SEED)).replace("LARGE", str(mixing.LARGE))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    """Five rounds written out: the nearest centroid is the least (distance, number), a mean is rounded down exactly."""
    steps = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x::DOUBLE) < 524288)) = 64)""",
        """c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 40))""",
    ]
    for n in range(centroids.ROUNDS + 1):
        steps.append(f"a{n} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v.v) AS v, min({{'d': list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.c}}) AS b FROM v, c{n} c GROUP BY r)")
        if n < centroids.ROUNDS:
            steps.append(f"s{n} AS (SELECT b.c AS c, p, sum(v[p])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n}, range(1, 65) t(p) GROUP BY ALL)")
            steps.append(f"m{n} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS v FROM s{n} GROUP BY c)")
            steps.append(f"c{n + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m USING (c))")
    last = centroids.ROUNDS
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, c.c::INTEGER AS cluster, a.b.d AS distance, (sum(a.b.d) OVER (PARTITION BY c.c))::BIGINT AS cluster_inertia,
  (sum(a.b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c ON a.b.c = c.c"""


def op12_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.retention(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"))


#: crc32 by a table of 256 remainders; both states from scratch.
_OP13_SQL = """
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
once AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
names AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(x, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS h
  FROM (SELECT click_id::VARCHAR AS x FROM once UNION SELECT client_id::VARCHAR FROM once), crc WHERE x IS NOT NULL),
e AS (SELECT client_id, epoch_us(ts) AS t, coalesce(kind = 'error', false) AS s, CASE WHEN value IS NOT NULL AND isfinite(value) THEN floor(100 * value + 0.5)::BIGINT ELSE 0 END AS cents,
  coalesce(epoch_us(arrived_at) + CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END * 86400000000 >= epoch_us(TIMESTAMP '2024-02-01'), true) AS late FROM once LEFT JOIN names ON click_id::VARCHAR = x),
k AS (SELECT 0 AS state, * FROM e WHERE NOT late UNION ALL SELECT 1, * FROM e),
b AS (SELECT state, client_id, min(t) AS start, CAST(floor(floor(min(t) / 86400000000) / 7) AS BIGINT) AS cohort FROM k WHERE s GROUP BY ALL),
n AS (SELECT b.*, coalesce(o.cohort <> b.cohort, false) AS moved, coalesce(c.source, '') AS segment, names.h FROM b LEFT JOIN b o ON o.client_id = b.client_id AND o.state <> b.state
  LEFT JOIN (SELECT client_id, min(source) AS source FROM clients GROUP BY 1) c ON c.client_id = b.client_id JOIN names ON names.x = b.client_id::VARCHAR),
u AS (SELECT state, client_id, segment, cohort, (t - start) // 604800000000 AS period, moved, h, sum(cents)::BIGINT AS cents FROM k JOIN n USING (state, client_id) WHERE t >= start GROUP BY ALL)
SELECT state::INTEGER AS state, segment, cohort, period::BIGINT AS period, count(*) AS users, sum(h)::BIGINT AS users_crc32, count(*) FILTER (WHERE moved) AS moved, sum(cents)::BIGINT AS cents FROM u GROUP BY state, segment, cohort, period
"""


QUERIES: dict[str, Query] = {"op1_simhash": op1_simhash, "op2_langid": op2_langid, "op3_quality": op3_quality, "op4_htmltext": op4_htmltext, "op5_sharding": op5_sharding, "op6_decontaminate": op6_decontaminate, "op7_chat": op7_chat, "op8_pii": op8_pii, "op9_media": op9_media, "op10_mixing": op10_mixing, "op11_centroids": op11_centroids, "op12_nndescent": op12_nndescent, "op13_cohorts": op13_cohorts}
ORACLES: dict[str, str] = {"op6_decontaminate": _OP6_SQL, "op10_mixing": _OP10_SQL, "op11_centroids": _op11_sql(), "op13_cohorts": _OP13_SQL}
