"""Controls, separated angles, synthetic examples and what surrounds a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import collect as C
from ..operators import signals as K
from ..operators import survey as Y
from ..sources import wav as WAV
from .registry import query

RATE = 48_000
ANGLES = (-15.0, 0.0, 20.0)
CHAINS = {"dry": [], "width": [("midside", {"width": 1.2})], "compression": [("compression", {"threshold_db": -30.0, "ratio": 3.0})]}


def _controls(v):
    """(track, chain, azimuth, error): each track's downmix panned to each angle, through each chain, measured."""
    e = v.embeddings.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg("col").cast("double").alias("x"))
    mono = e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("m")).select(F.col("label").alias("track"), F.flatten(F.array_repeat("m", 128)).alias("mono"))
    steps = F.array(*[F.struct(F.lit(n).alias("chain"), F.array(*[F.struct(F.lit(k).alias("kind"), F.create_map(*[F.lit(x) for p in q.items() for x in p]).alias("params")) for k, q in s]).cast("array<struct<kind: string, params: map<string, double>>>").alias("processing")) for n, s in CHAINS.items()])
    grid = mono.withColumn("azimuth", F.explode(F.array(*map(F.lit, ANGLES)))).select("track", "mono", "azimuth", F.inline(steps))
    keys = ["track", "chain", "azimuth"]
    done = K.measured(K.processed(K.rendered(K.spread(grid), [*keys, "processing"], RATE, "amplitude"), keys, RATE), keys, RATE)
    return done.withColumn("error", F.abs(F.col("estimated_azimuth_deg") - F.col("azimuth")))


_WIDE = "abs(degrees(atan(1.2 * tan(radians(a)))) - a)"
_ERRORS = f"SELECT label AS track, c.chain, a.a AS azimuth, round(CASE WHEN c.chain = 'width' THEN {_WIDE} ELSE 0 END, 3) + 0.0 AS error FROM (SELECT DISTINCT label FROM embeddings) l, (SELECT unnest(['dry', 'width', 'compression']) AS chain) c, (SELECT CAST(unnest([-15, 0, 20]) AS DOUBLE) AS a) a"


@query("control_recovery", _ERRORS)
def control_recovery(v):
    return _controls(v).select("track", "chain", "azimuth", (F.round("error", 3) + 0.0).alias("error"))


@query("control_worst_by_chain", f"SELECT chain, max(error) AS worst FROM ({_ERRORS}) e GROUP BY chain")
def control_worst_by_chain(v):
    return Y.worst(_controls(v).withColumn("error", F.round("error", 3) + 0.0), "chain", "error")


@query("separated_angles", "SELECT piece_id, least(n, 5) AS n, true AS separated FROM (SELECT piece_id, count(*) AS n FROM {stems} GROUP BY piece_id HAVING count(*) >= 2) x")
def separated_angles(v):
    """2 to 5 angles a piece, at least 10 degrees apart, ascending, of the grid."""
    groups = v.stems.groupBy("piece_id").agg(F.least(F.count("*"), F.lit(5)).alias("n")).filter("n >= 2")
    a, grid = F.col("angles"), [float(x) for x in range(-25, 30, 5)]
    apart = (F.size(a) == F.col("n")) & F.forall(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.element_at(a, i + 1) - F.element_at(a, i) >= 10.0) & F.forall(a, lambda x: F.array_contains(F.array(*map(F.lit, grid)), x))
    return C.separated_angles(groups, "piece_id", "n", grid, 2026).select("piece_id", "n", F.coalesce(apart, F.lit(False)).alias("separated"))


@query("infeasible_angles", "SELECT piece_id, n, CASE WHEN n <= 3 THEN n END AS found FROM (SELECT piece_id, 2 + count(*) % 4 AS n FROM {stems} GROUP BY piece_id) x")
def infeasible_angles(v):
    """A grid that holds three such angles at most: more are never found, three always."""
    groups = v.stems.groupBy("piece_id").agg((2 + F.count("*") % 4).alias("n"))
    return C.separated_angles(groups, "piece_id", "n", [-10.0, -5.0, 0.0, 5.0, 10.0], 2026).select("piece_id", "n", F.when(F.col("angles").isNotNull(), F.size("angles")).cast("long").alias("found"))


@query("parameters_by_component", "SELECT l_returnflag AS component, sum(CASE WHEN l_linestatus = 'O' THEN l_partkey ELSE 0 END) AS trainable, sum(l_partkey) AS total, round(100.0 * sum(CASE WHEN l_linestatus = 'O' THEN l_partkey ELSE 0 END) / sum(l_partkey), 6) AS percent FROM lineitem GROUP BY 1")
def parameters_by_component(v):
    rows = v.lineitem.select(F.concat("l_returnflag", F.lit("."), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_partkey").alias("size"), (F.col("l_linestatus") == "O").alias("on"))
    return C.parameters_by_component(rows, "name", "size", "on")


@query("provider_text", "SELECT o_orderkey AS id, concat('answer ', CAST(o_orderkey AS VARCHAR)) AS text FROM orders")
def provider_text(v):
    said = F.concat(F.lit("answer "), F.col("o_orderkey").cast("string"))
    shapes = F.element_at(F.array(said, F.to_json(F.struct(said.alias("text"))), F.to_json(F.array(F.struct(said.alias("output")))), F.to_json(F.array(said)), F.to_json(F.array(F.array(F.struct(F.lit("").alias("json_str"), said.alias("text")))))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return v.orders.select(F.col("o_orderkey").alias("id"), C.provider_text(shapes).alias("text"))


@query("wav_payload", "SELECT clip_id, CAST(4 * ((44 + 32 * 2 * 2 + 2) // 3) AS INT) AS characters, CAST(sum(round(greatest(-1, least(1, l)) * 32767)) AS BIGINT) AS left_sum, CAST(sum(round(greatest(-1, least(1, r)) * 32767)) AS BIGINT) AS right_sum FROM {samples} GROUP BY clip_id")
def wav_payload(v):
    """Clips as base64 of their WAV bytes, read back sample by sample."""
    sent = WAV.as_wav(v.clips, ["clip_id"], RATE).select("clip_id", F.base64("wav").alias("payload"))
    back = WAV.from_wav(sent.select("clip_id", "payload", F.unbase64("payload").alias("wav")), ["clip_id", "payload"])
    ints = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.round(x * 32768).cast("long"))
    return back.select("clip_id", F.length(F.regexp_replace("payload", r"\s", "")).alias("characters"), ints("left").alias("left_sum"), ints("right").alias("right_sum"))


_DENSE = "CAST(('0x' || substr(sha256(concat('7:', CAST(id AS VARCHAR), ':0')), 1, 12))::UBIGINT AS DOUBLE) / 281474976710656.0 * 50.0 - 25.0"


@query("dense_examples", f"""WITH d AS (SELECT o_orderkey AS id, {_DENSE.replace('id AS VARCHAR', 'o_orderkey AS VARCHAR')} AS a FROM orders)
SELECT id, CASE WHEN abs(a - round(a / 5) * 5) > 0.2 THEN round(a, 6) END AS azimuth, CASE id % 3 WHEN 0 THEN 'a.wav' WHEN 1 THEN 'b.wav' ELSE 'c.wav' END AS audio_path, CASE id % 2 WHEN 0 THEN 'cello' ELSE 'flute' END AS instrument, true AS reads_back FROM d""")
def dense_examples(v):
    """Synthetic cue examples for every order, between the grid's angles; where a first draw is too near one, SQL leaves its azimuth open.
    Each target states the azimuth that it was made for."""
    grid = [float(a) for a in range(-25, 30, 5)]
    angles = K.per_row(K.spread(v.orders).select(F.col("o_orderkey").alias("id")), ["id"], ["id"], lambda i: {"azimuth": C.draw_clear(i, grid, 7, 25.0), "first": C.draw_clear(i, [], 7, 25.0)}, "azimuth double, first double")
    made = C.dense_examples(angles, ["a.wav", "b.wav", "c.wav"], ["cello", "flute"], keep=("first",))
    clear = F.abs(F.col("first") - F.round(F.col("first") / 5) * 5) > 0.2
    said = F.abs(T.signed_azimuth(F.col("target")) - F.col("azimuth")) <= 1
    return made.select("id", F.when(clear, F.round("azimuth", 6)).alias("azimuth"), "audio_path", "instrument", said.alias("reads_back"))


@query("second_opinion", "SELECT vec_id AS clip_id, CASE WHEN vec_id % 3 = 0 THEN 'amplitude' ELSE 'delayed' END AS regime FROM embeddings")
def second_opinion(v):
    """Panned noise, two thirds of it with a late right channel."""
    rows = K.spread(v.embeddings).select(F.col("vec_id").alias("clip_id"), ((F.col("vec_id") % 11) * 5 - 25).cast("double").alias("azimuth"))
    panned = K.rendered(K.noises(rows, ["clip_id", "azimuth"], 8192, "clip_id"), ["clip_id"], RATE, "amplitude")
    late = F.array(F.struct(F.lit("delay_widening").alias("kind"), F.create_map(F.lit("delay_us"), (F.col("clip_id") % 3 * 200).cast("double")).alias("params")))
    return C.second_opinion(K.processed(panned.withColumn("processing", late), ["clip_id"], RATE), ["clip_id"], RATE).select("clip_id", "regime")


@query("answer_pairs", "SELECT o_orderkey AS id, o_orderkey % 40 - 20.5 AS level, o_orderkey % 50 - 24.5 AS azimuth FROM orders WHERE o_orderkey % 3 <> 0")
def answer_pairs(v):
    """Level and azimuth that derived answers state; a third of them leaves one out."""
    k = F.col("o_orderkey")
    said = F.concat(F.lit("The level difference is "), (k % 40 - 20.5).cast("string"), F.lit(" dB, so "), F.when(k % 3 != 0, F.concat(F.lit("azimuth = arctan(0.2 * tan 30deg) = "), (k % 50 - 24.5).cast("string"))).otherwise("it is near the centre"), F.lit(" degrees."))
    return v.orders.select(k.alias("id"), T.answer_pair(said).alias("p")).filter("p IS NOT NULL").select("id", "p.level", "p.azimuth")


@query("adapter_folders", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'cues' WHEN 1 THEN 'cues_enc-full' ELSE 'cues_enc-none' END AS folder, CASE o_orderkey % 3 WHEN 1 THEN 'audio_tower,multi_modal_projector' ELSE '' END AS trained FROM orders")
def adapter_folders(v):
    mode = F.element_at(F.array(*map(F.lit, ("qkv", "full", "none"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return v.orders.select(F.col("o_orderkey").alias("id"), C.adapter_folder(F.lit("cues"), mode).alias("folder"), F.array_join(C.directly_trained(mode), ",").alias("trained"))


@query("known_fields", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'coherence,itd_us' ELSE 'itd_us' END AS fields FROM orders")
def known_fields(v):
    k = F.col("o_orderkey")
    record = F.when(k % 2 == 0, F.to_json(F.struct(k.alias("itd_us"), k.alias("other"), k.alias("coherence")))).otherwise(F.to_json(F.struct(k.alias("more"), k.alias("itd_us"))))
    return v.orders.select(k.alias("id"), F.array_join(C.known_fields(record, ["ild_db", "itd_us", "coherence"]), ",").alias("fields"))
