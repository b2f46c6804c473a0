"""Queries whose operators work in passes or pieces: exact quantiles, interval joins, leave-one-group-out fits, recurrences, unranked choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as M
from ..operators import collect as C
from ..operators import joins as J
from ..operators import quantiles as Q
from ..operators import recurrences as R
from ..operators import score as S
from ..operators import signals as K
from .registry import query
from .scoring import SCORED

_PRICES = "SELECT l_returnflag AS flag, CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END AS price FROM lineitem"


def _prices(v):
    k = F.col("l_orderkey")
    return v.lineitem.select(F.col("l_returnflag").alias("flag"), F.when(k % 97 == 0, None).when(k % 101 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("price"))


@query("exact_median", f"SELECT round(quantile_cont(price, 0.5), 6) AS median FROM ({_PRICES}) x")
def exact_median(v):
    """Of the whole table, nulls left out and NaN above all; so low a limit that it takes passes."""
    return Q.median(_prices(v), "price", limit=1000).select(F.round("median", 6).alias("median"))


@query("exact_quantiles", f"SELECT flag, round(quantile_cont(price, 0.025), 6) AS low, round(quantile_cont(price, 0.5), 6) AS mid, round(quantile_cont(price, 0.9), 6) AS high, round(quantile_cont(price, 0.98), 6) AS top FROM ({_PRICES}) x GROUP BY flag")
def exact_quantiles(v):
    found = Q.quantiles(_prices(v), "price", {"low": 0.025, "mid": 0.5, "high": 0.9, "top": 0.98}, "flag", limit=2000)
    return found.select("flag", *[F.round(c, 6).alias(c) for c in ("low", "mid", "high", "top")])


@query("error_quantiles", SCORED + "SELECT instrument, round(quantile_cont(abs_error, 0.5), 6) AS median_error, round(quantile_cont(abs_error, 0.95), 6) AS p95 FROM scored GROUP BY instrument")
def error_quantiles(v):
    """Median and 95th percentile of the errors over answered items, by selection."""
    found = Q.quantiles(S.score(v.items, v.answers), "abs_error", {"median_error": 0.5, "p95": 0.95}, "instrument")
    return found.select("instrument", *[F.round(c, 6).alias(c) for c in ("median_error", "p95")])


_SPANS = """SELECT s_suppkey AS span, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_acctbal - s_suppkey % 7 * 500.0 END AS low, CASE WHEN s_suppkey % 15 = 0 THEN NULL ELSE s_acctbal + s_suppkey % 5 * 300.0 - 200.0 END AS high FROM supplier"""


@query("interval_join", f"SELECT span, count(*) AS n, min(c_acctbal) AS least, max(c_acctbal) AS most, sum(c_custkey) AS keys FROM customer JOIN ({_SPANS}) x ON (low IS NULL OR c_acctbal >= low) AND (high IS NULL OR c_acctbal <= high) AND (low IS NULL OR high IS NULL OR low <= high) GROUP BY span")
def interval_join(v):
    """Customers by the ranges around suppliers' balances: nested, open at either end or both, of one value, empty."""
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    spans = v.supplier.select(k.alias("span"), F.when(k % 10 != 0, b - k % 7 * 500.0).alias("low"), F.when(k % 15 != 0, b + k % 5 * 300.0 - 200.0).alias("high"))
    totals = {"n": ("count", "*"), "least": ("min", "c_acctbal"), "most": ("max", "c_acctbal"), "keys": ("sum", "c_custkey")}
    return J.totals_in_ranges(v.customer, spans, "span", "c_acctbal", "low", "high", 0.01, totals)


#: Gauss-Jordan elimination of each group's normal equations, a column a step.
_RIDGE = """WITH RECURSIVE r AS (SELECT vec_id, vec_id % {groups} AS g, list_concat([1.0::DOUBLE], list_concat({features}, [label::DOUBLE])) AS z FROM embeddings),
mom AS (SELECT g, i, j, sum(z[i] * z[j]) AS s FROM r, range(1, {wide} + 2) a(i), range(1, {wide} + 2) b(j) GROUP BY ALL),
tot AS (SELECT i, j, sum(s) AS s FROM mom GROUP BY i, j),
cells AS (SELECT m.g, m.i, m.j, t.s - m.s + CASE WHEN m.i = m.j AND m.i > 1 THEN 1.0 ELSE 0.0 END AS v FROM mom m JOIN tot t ON m.i = t.i AND m.j = t.j WHERE m.i <= {wide}),
mat AS (SELECT g, list(line ORDER BY i) AS m FROM (SELECT g, i, list(v ORDER BY j) AS line FROM cells GROUP BY g, i) x GROUP BY g),
gj AS (SELECT g, 1 AS k, m FROM mat UNION ALL
  SELECT g, k + 1, list_transform(m, lambda line, i: CASE WHEN i = k THEN list_transform(line, lambda x: x / m[k][k]) ELSE list_transform(line, lambda x, j: x - line[k] * m[k][j] / m[k][k]) END) FROM gj WHERE k <= {wide}),
w AS (SELECT g, list_transform(m, lambda line: line[{wide} + 1]) AS w FROM gj WHERE k = {wide} + 1),
p AS (SELECT vec_id, z[{wide} + 1] AS y, list_dot_product(w, z[1 : {wide}]) AS predicted FROM r JOIN w ON r.g = w.g)
"""


def ridge_sql(groups: int, features: str, wide: int) -> str:
    return _RIDGE.replace("{groups}", str(groups)).replace("{features}", features).replace("{wide}", str(wide))


@query("ridge_two_features", ridge_sql(40, "[embedding[1]::DOUBLE, embedding[2]::DOUBLE]", 3) + "SELECT vec_id, round(predicted, 6) AS predicted FROM p")
def ridge_two_features(v):
    """Each row's label from two components, fitted without its group."""
    rows = v.embeddings.select("vec_id", F.slice("embedding", 1, 2).alias("x"), "label", (F.col("vec_id") % 40).alias("part"))
    return K.leave_one_group_out(rows, "vec_id", "x", "label", "part", 1.0).select(F.col("key").alias("vec_id"), F.round("predicted", 6).alias("predicted"))


_C = (1.02, -1.9, 0.95, -1.9, 0.97)


@query(
    "biquad_stretches",
    f"""WITH RECURSIVE f AS (SELECT clip_id, 0 AS pos, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS q FROM (SELECT DISTINCT clip_id FROM {{samples}}) x
UNION ALL SELECT s.clip_id, CAST(s.pos AS INT), {_C[0]} * s.l + f.p, {_C[1]} * s.l - ({_C[3]}) * ({_C[0]} * s.l + f.p) + f.q, {_C[2]} * s.l - {_C[4]} * ({_C[0]} * s.l + f.p) FROM f JOIN {{samples}} s ON s.clip_id = f.clip_id AND s.pos = f.pos + 1)
SELECT clip_id, pos, round(y, 6) AS y FROM f WHERE pos > 0""",
)
def biquad_stretches(v):
    """A resonant filter along each clip, cut into stretches of 8 samples that run at once."""
    stretches = R.cut(v.clips, "clip_id", "left", 8).withColumn("c", F.array(*map(F.lit, _C)))
    filtered = R.biquad(stretches, "clip_id")
    return filtered.select("clip_id", "stretch", F.posexplode("y").alias("at", "y")).select("clip_id", (F.col("stretch") * 8 + F.col("at") + 1).alias("pos"), F.round("y", 6).alias("y"))


@query(
    "compressor_stretches",
    """WITH RECURSIVE lv AS (SELECT clip_id, pos, greatest(20 * log10(greatest(greatest(abs(l), abs(r)), 1e-9)) + 20.0, 0.0) * 0.75 AS target FROM {samples}),
g AS (SELECT clip_id, 0 AS pos, CAST(0.0 AS DOUBLE) AS now FROM (SELECT DISTINCT clip_id FROM lv) x UNION ALL SELECT lv.clip_id, CAST(lv.pos AS INT), CASE WHEN lv.target > g.now THEN 0.5 ELSE 0.9 END * g.now + (1 - CASE WHEN lv.target > g.now THEN 0.5 ELSE 0.9 END) * lv.target FROM g JOIN lv ON lv.clip_id = g.clip_id AND lv.pos = g.pos + 1)
SELECT clip_id, pos, round(now, 6) AS reduction_db FROM g WHERE pos > 0""",
)
def compressor_stretches(v):
    """The whole course of the gain reduction, in stretches of 8 levels."""
    level = F.zip_with("left", "right", lambda a, b: 20 * F.log10(F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))))
    done = R.compressor(R.cut(v.clips.select("clip_id", level.alias("level")), "clip_id", "level", 8), "clip_id", -20.0, 4.0, 0.5, 0.9)
    return done.select("clip_id", "stretch", F.posexplode("y").alias("at", "y")).select("clip_id", (F.col("stretch") * 8 + F.col("at") + 1).alias("pos"), F.round("y", 6).alias("reduction_db"))


@query("running_totals", "SELECT l_returnflag AS flag, l_orderkey * 10 + l_linenumber AS at, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT l_returnflag, l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) x")
def running_totals(v):
    """Along three long keys, each cut into stretches."""
    rows = v.lineitem.groupBy(F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")).agg(F.sum("l_quantity").alias("v"))
    return R.running_sum(rows, "flag", "at", "v", 20_000)


#: All choices of n angles, each 10 degrees above the one before, in order.
_CHOICES = """WITH RECURSIVE c AS (SELECT 1 AS n, [a] AS angles FROM (SELECT unnest(range(-25, 30, 5)) AS a) x UNION ALL SELECT n + 1, list_append(angles, a) FROM c, (SELECT unnest(range(-25, 30, 5)) AS a) y WHERE a - angles[n] >= 10 AND n < 7),
numbered AS (SELECT n, angles, row_number() OVER (PARTITION BY n ORDER BY angles) - 1 AS rank, count(*) OVER (PARTITION BY n) AS ways FROM c),
asked AS (SELECT p_partkey AS part, p_partkey % 7 + 1 AS n, CAST(('0x' || substr(sha256('2026:angles:' || p_partkey::VARCHAR), 1, 12))::UBIGINT AS DOUBLE) / 281474976710656.0 AS u FROM part)
"""


@query("angle_choices", _CHOICES + "SELECT part, a.n, array_to_string(angles, ',') AS angles FROM asked a LEFT JOIN numbered b ON a.n = b.n AND b.rank = floor(a.u * b.ways)")
def angle_choices(v):
    """1 to 7 separated angles of the grid for each part; 7 can't be had."""
    asked = v.part.select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % 7 + 1).alias("n"))
    found = C.separated_angles(asked, "part", "n", [float(a) for a in range(-25, 30, 5)], 2026)
    return found.select("part", "n", F.array_join(F.transform("angles", lambda a: a.cast("int").cast("string")), ",").alias("angles"))


_WEIGHTED = """WITH v AS (SELECT l_shipdate::DATE::VARCHAR AS day, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
r AS (SELECT day, x, sum(w) OVER (PARTITION BY day ORDER BY x) AS so_far, sum(w) OVER (PARTITION BY day) AS total FROM v)
SELECT day, min(x) AS median FROM r WHERE so_far >= total / 2 GROUP BY day"""


@query("weighted_medians", _WEIGHTED)
def weighted_medians(v):
    """Of prices by quantity, a day's."""
    rows = v.lineitem.withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return M.weighted_median(rows, "day", "l_extendedprice", "l_quantity")


@query("weighted_medians_sql", _WEIGHTED.replace("l_shipdate::DATE::VARCHAR", "l_linenumber::VARCHAR").replace("day", "line"))
def weighted_medians_sql(v):
    """Runs by the table function, below the shuffle; the few groups are too large to be merged in a task each."""
    M.register(v.spark)
    runs = v.spark.sql("SELECT k AS line, values, weights FROM cue_runs(TABLE(SELECT CAST(l_linenumber AS STRING), l_extendedprice, l_quantity FROM {lineitem}))", lineitem=v.lineitem)
    return M.medians_of_runs(runs, "line")


_ANSWERED = "SELECT o_orderpriority AS build, o_orderstatus AS split, CASE WHEN o_orderkey % 41 > 0 THEN round(o_totalprice / 50) END AS angle FROM orders"


@query("answer_sketches", f"SELECT split, count(angle) AS n, true AS count_holds, true AS median_holds, true AS merge_holds FROM ({_ANSWERED}) x GROUP BY split")
def answer_sketches(v):
    """States of each build and split, merged by split and through builds: different answers and median within the sketches' errors of what
    an exact count says."""
    k = F.col("o_orderkey")
    rows = v.orders.select(F.col("o_orderpriority").alias("build"), F.col("o_orderstatus").alias("split"), F.when(k % 41 > 0, F.round(F.col("o_totalprice") / 50)).alias("angle"))
    states = M.sketched(rows, "angle", "build", "split")
    told = M.merged(states, "split").select("split", "n", M.distinct_answers().alias("about"), M.answer_quantile(0.5).alias("mid"))
    again = M.merged(M.merged(states, "split", "build"), "split").select("split", M.distinct_answers().alias("about_again"))
    exact = rows.join(told, "split").groupBy("split").agg(F.countDistinct("angle").alias("d"), F.avg((F.col("angle") <= F.col("mid")).cast("double")).alias("upto"), F.avg((F.col("angle") < F.col("mid")).cast("double")).alias("below"))
    both = told.join(again, "split").join(exact, "split")
    holds = (F.col("upto") >= 0.5 - M.RANK_ERROR) & (F.col("below") <= 0.5 + M.RANK_ERROR)
    return both.select("split", "n", (F.abs(F.col("about") / F.col("d") - 1) <= 2 * M.COUNT_ERROR).alias("count_holds"), holds.alias("median_holds"), (F.abs(F.col("about_again") / F.col("about") - 1) <= M.COUNT_ERROR).alias("merge_holds"))
