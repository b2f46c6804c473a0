"""Queries that write derived rows to the shared folder in the formats of builds, answers and audio, and give what reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collect as C
from ..operators import plan as P
from ..operators import prompts as R
from ..operators import score as S
from ..sources import committed, ranges, records, shared, variants, wav
from ..streaming import answers, events
from .generalization import training_examples
from .registry import query
from .scoring import REPORT, SCORED

_SPLIT = "CASE WHEN piece % 10 < 6 THEN 'train' WHEN piece % 10 < 8 THEN 'dev' ELSE 'test' END"


def _split(v):
    return v.items.withColumn("split", F.expr(_SPLIT))


def _parsed(lines, schema: str):
    return lines.select("output", F.from_json("line", schema).alias("r")).select("output", "r.*")


@query(
    "benchmark_outputs",
    f"""WITH s AS (SELECT *, {_SPLIT} AS split FROM {{items}})
SELECT split AS output, item_id, azimuth, instrument FROM s WHERE split <> 'test' UNION ALL SELECT 'test_public', item_id, NULL, instrument FROM s WHERE split = 'test'
UNION ALL SELECT 'test_private_labels', item_id, azimuth, NULL FROM s WHERE split = 'test' UNION ALL SELECT 'rejected_items', item_id, NULL, NULL FROM s WHERE item_id % 50 = 0""",
)
def benchmark_outputs(v):
    """The five outputs of a build, committed at once; the job runs twice and its lines are there once."""
    items, path = _split(v), shared.folder(v.spark, "benchmark")
    for _ in range(2):
        records.write_benchmark(items, items.filter("item_id % 50 = 0").select("item_id"), path, ["item_id", "split", "instrument"], ["item_id", "azimuth"], job="v1")
    return _parsed(committed.read(v.spark, path), "item_id long, azimuth double, instrument string")


@query("benchmark_dev", f"SELECT item_id, azimuth FROM (SELECT *, {_SPLIT} AS split FROM {{items}}) s WHERE split = 'dev'")
def benchmark_dev(v):
    """One output of a build by a pushed filter; the files of the others stay closed. A later job replaces an earlier one."""
    path, none = shared.folder(v.spark, "benchmark"), v.items.limit(0).select("item_id")
    records.write_benchmark(_split(v).limit(100), none, path, ["item_id"], ["item_id"], job="draft")
    lines = records.benchmark_lines(_split(v), none, ["item_id"], ["item_id"])
    committed.write(lines, path, "final", overwrite=True)
    return _parsed(committed.read(v.spark, path).filter("output = 'dev'"), "item_id long, azimuth double").drop("output")


@query("collected_answers", "SELECT item_id, item_id % 3 AS run FROM {items}")
def collected_answers(v):
    """Answers that three runs have collected, each of the items that were open then."""
    folder = shared.folder(v.spark, "answers")
    for run in range(3):
        events.collect_missing(v.items.filter(F.col("item_id") % 3 <= run).select("item_id"), folder, lambda todo, run=run: todo.withColumn("answer", F.lit(f"run {run}")))
    return _parsed(committed.read(v.spark, folder), "item_id long, answer string").select("item_id", F.substring("answer", 5, 1).cast("long").alias("run"))


_PAGED = "SELECT (c_custkey - c_custkey % 100) // 100 AS page, c_custkey AS k, c_nationkey AS artist FROM customer"


@query(
    "paged_artists",
    f"""WITH RECURSIVE r AS ({_PAGED}),
t AS (SELECT 0 AS page, (SELECT min(k) FROM r WHERE page = 0) AS k, [(SELECT arg_min(artist, k) FROM r WHERE page = 0)] AS seen
  UNION ALL SELECT t.page + 1, (SELECT min(k) FROM r WHERE r.page = t.page + 1 AND NOT list_contains(t.seen, r.artist)), list_append(t.seen, (SELECT arg_min(artist, k) FROM r WHERE r.page = t.page + 1 AND NOT list_contains(t.seen, r.artist))) FROM t WHERE t.page < (SELECT max(page) FROM r))
SELECT k, list_extract(seen, len(seen)) AS artist FROM t WHERE k IS NOT NULL""",
)
def paged_artists(v):
    """Customers as lines of a file that is read in pages of 4 KB; of each hundred the first whose nation none before has given."""
    path, k = shared.folder(v.spark, "pages"), F.col("c_custkey")
    rows = v.customer.select(F.floor(k / 100).alias("page"), k.alias("k"), F.col("c_nationkey").alias("artist"))
    records.write_jsonl(rows, path, "k")
    told = ranges.lines(v.spark, path, 4096, ".json").select(F.from_json("line", "page long, k long, artist long").alias("r")).select("r.*")
    return P.one_a_page(told, "page", "k", "artist").select("k", "artist")


@query("paged_lines", "SELECT count(*) AS lines, sum(c_custkey) AS keys, count(DISTINCT c_custkey) AS distinct_keys FROM customer")
def paged_lines(v):
    """No line is lost or read twice where pages of 1,000 bytes end."""
    path = shared.folder(v.spark, "lines")
    records.write_jsonl(v.customer.select(F.col("c_custkey").alias("k"), F.repeat(F.lit("x"), (F.col("c_custkey") % 90).cast("int")).alias("filler")), path)
    told = ranges.lines(v.spark, path, 1000, ".json").select(F.get_json_object("line", "$.k").cast("long").alias("k"))
    return told.agg(F.count("*").alias("lines"), F.sum("k").alias("keys"), F.countDistinct("k").alias("distinct_keys"))


#: A sample as the whole number that 24 bits hold.
_PCM = "CAST(round_even({} * 8388607.0::DOUBLE, 0) AS BIGINT)"


def _pcm_sum(samples: str):
    return F.aggregate(samples, F.lit(0).cast("long"), lambda a, x: a + F.round(x * (1 << 23)).cast("long"))


def _mono(v):
    """Each vector as a file of 64 samples."""
    code = F.element_at(F.array(*map(F.lit, ("vn", "vc", "fl"))), (F.col("vec_id") % 3 + 1).cast("int"))
    samples = F.transform("embedding", lambda x: x.cast("double"))
    rows = v.embeddings.select("vec_id", F.format_string("AuSep_%d_%s_%02d_Piece.wav", F.col("vec_id"), code, F.col("vec_id") % 100).alias("name"), samples.alias("left"))
    path = shared.folder(v.spark, "stems")
    wav.write_files(wav.as_wav(rows.withColumn("right", F.col("left")), ["name"], 48_000, 24), path)
    return path


@query("wav_inventory", "SELECT vec_id AS track, CASE vec_id % 3 WHEN 0 THEN 'violin' WHEN 1 THEN 'cello' ELSE 'flute' END AS instrument, vec_id % 100 AS piece_number, 48000 AS rate, 2 AS channels, 64 AS frames FROM embeddings")
def wav_inventory(v):
    """Files of 24 bits as their headers and names tell."""
    found = ranges.frames(v.spark, _mono(v)).select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("stem"), "rate", "channels", F.size("samples").alias("n"))
    return P.parse_stems(found, "stem").select("track", "instrument", "piece_number", "rate", "channels", (F.col("n") / F.col("channels")).cast("int").alias("frames"))


@query("wav_blocks", f"SELECT vec_id, CAST(sum({_PCM.format('x')}) AS BIGINT) AS total FROM (SELECT vec_id, unnest(embedding[17:48]) AS x FROM embeddings) y GROUP BY vec_id")
def wav_blocks(v):
    """Frames 16 to 47 of every file, read in stretches of 96 bytes, of which those in between are opened."""
    part = ranges.frames(v.spark, _mono(v), 96).filter("start >= 16 AND start < 48")
    sums = part.select(F.regexp_extract("path", r"AuSep_(\d+)_", 1).cast("long").alias("vec_id"), _pcm_sum("samples").alias("s"))
    return sums.groupBy("vec_id").agg((F.sum("s") / 2).cast("long").alias("total"))


@query("seek_excerpts", f"SELECT vec_id, k, CAST(list_sum(list_transform(embedding[k * 16 + 1 : k * 16 + 16], lambda x: {_PCM.format('x')})) AS BIGINT) AS total FROM embeddings, (SELECT unnest(range(0, 4)) AS k) y")
def seek_excerpts(v):
    """Four excerpts of every file; plans meet paths, and tasks read the frames of a plan."""
    plans = v.embeddings.select("vec_id", F.format_string("AuSep_%d_%s_%02d_Piece", F.col("vec_id"), F.element_at(F.array(*map(F.lit, ("vn", "vc", "fl"))), (F.col("vec_id") % 3 + 1).cast("int")), F.col("vec_id") % 100).alias("stem"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    timed = plans.withColumn("start_s", F.col("k") * 16 / 48_000).withColumn("duration_s", F.lit(16 / 48_000))
    found = wav.excerpts(v.spark, timed, _mono(v), 48_000, ["vec_id", "k"])
    return found.select("vec_id", "k", _pcm_sum("mono").alias("total"))


@query("stereo_files", f"SELECT clip_id, CAST(sum({_PCM.format('l')}) AS BIGINT) AS left_sum, CAST(sum({_PCM.format('r')}) AS BIGINT) AS right_sum FROM {{samples}} GROUP BY clip_id")
def stereo_files(v):
    """Clips as stereo files of 24 bits, read by their bytes."""
    path = shared.folder(v.spark, "clips")
    wav.write_files(wav.as_wav(v.clips.withColumn("name", F.format_string("%d.wav", "clip_id")), ["name"], 48_000, 24), path)
    return wav.stereo(v.spark, path).select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("clip_id"), _pcm_sum("left").alias("left_sum"), _pcm_sum("right").alias("right_sum"))


@query("audio_discovery", "SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'wav' WHEN o_orderkey % 4 = 1 THEN 'FLAC' ELSE 'mp3' END AS suffix, count(*) AS n FROM orders WHERE o_orderkey % 4 < 3 AND o_orderkey < 400 GROUP BY 1")
def audio_discovery(v):
    """Files by suffix, whatever its case; a fourth of them is no audio. One file for each order below 400."""
    suffix = F.element_at(F.array(*map(F.lit, ("wav", "FLAC", "mp3", "txt"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    path = shared.folder(v.spark, "discovery")
    wav.write_files(v.orders.filter("o_orderkey < 400").select(F.format_string("%d.%s", F.col("o_orderkey"), suffix).alias("name"), F.lit("x").cast("binary").alias("wav")), path)
    return wav.discover(v.spark, path).groupBy(F.regexp_extract("path", r"\.(\w+)$", 1).alias("suffix")).agg(F.count("*").alias("n"))


@query("label_lines", "SELECT CAST(item_id AS VARCHAR) AS item_id, 'b1' AS build_id, azimuth, instrument, CASE WHEN item_id % 5 > 0 THEN azimuth * 0.75 END AS ild_db FROM {items}")
def label_lines(v):
    """Labels as JSON lines of both shapes: the answer at the top or in `question`; a fifth without evidence."""
    path, top = shared.folder(v.spark, "labels"), F.col("item_id") % 2 == 0
    answer = F.struct(F.when(~top, F.lit("left")).alias("answer_side"), F.when(~top, F.col("azimuth")).alias("answer_azimuth_deg"))
    rows = v.items.select(F.col("item_id").cast("string").alias("item_id"), F.lit("b1").alias("build_id"), F.when(top, F.lit("left")).alias("answer_side"), F.when(top, F.col("azimuth")).alias("answer_azimuth_deg"), F.when(~top, answer).alias("question"), F.struct("instrument").alias("render"), F.when(F.col("item_id") % 5 > 0, F.struct((F.col("azimuth") * 0.75).alias("ild_db"))).alias("measured_evidence"))
    rows.write.json(path)
    return records.labels(v.spark, path).select("item_id", "build_id", "azimuth", "instrument", F.col("evidence.ild_db").alias("ild_db"))


@query("mixture_label_lines", "SELECT CAST(item_id AS VARCHAR) AS item_id, count(*) AS sources, sum(azimuth) AS total FROM {mix_items} GROUP BY item_id")
def mixture_label_lines(v):
    path, top = shared.folder(v.spark, "mixtures"), F.col("item_id") % 2 == 0
    rows = v.mix_items.groupBy("item_id").agg(F.sort_array(F.collect_list("azimuth")).alias("a"))
    rows.select(F.col("item_id").cast("string").alias("item_id"), F.when(top, F.col("a")).alias("answer_azimuths_deg"), F.when(~top, F.struct(F.col("a").alias("answer_azimuths_deg"))).alias("question")).write.json(path)
    return records.mixture_labels(v.spark, path).select("item_id", F.size("azimuths").cast("long").alias("sources"), F.aggregate("azimuths", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("answer_lines", "SELECT CAST(item_id AS VARCHAR) AS item_id, CASE WHEN item_id % 3 = 0 THEN concat('again ', answer) ELSE answer END AS answer FROM {answers}")
def answer_lines(v):
    """Answers as JSON lines, under either key; a third was answered twice, and the later attempt counts."""
    path, own = shared.folder(v.spark, "answers"), F.col("item_id") % 2 == 0
    twice = v.answers.withColumn("attempt", F.lit(1)).unionByName(v.answers.filter("item_id % 3 = 0").select("item_id", F.concat(F.lit("again "), "answer").alias("answer"), F.lit(2).alias("attempt")))
    twice.select(F.col("item_id").cast("string").alias("item_id"), "attempt", F.when(own, F.col("answer")).alias("answer"), F.when(~own, F.col("answer")).alias("transcript")).write.json(path)
    return records.answers(v.spark, path)


@query("first_build_id", "SELECT concat('b', CAST(min(o_orderkey) AS VARCHAR)) AS build_id FROM orders")
def first_build_id(v):
    """Of the first line of a file in order."""
    path = shared.folder(v.spark, "build")
    v.orders.select(F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("build_id"), "o_orderkey").orderBy("o_orderkey").coalesce(1).write.json(path)
    found = records.build_id(v.spark, path)
    return v.spark.range(1).select(F.lit(found).alias("build_id"))


@query("pitch_annotations", "SELECT CAST(t AS DOUBLE) AS t, f0 FROM {frames}")
def pitch_annotations(v):
    path = shared.folder(v.spark, "f0")
    records.write_f0_annotations(v.frames.select(F.col("t").cast("double").alias("t"), "f0"), path)
    return records.f0_annotations(v.spark, path)


@query("report_file", SCORED + f"SELECT instrument, {REPORT} FROM scored GROUP BY instrument")
def report_file(v):
    """The reports of the instruments in one JSON object."""
    path = shared.folder(v.spark, "reports")
    records.write_reports(S.report(S.score(v.items, v.answers), "instrument"), "labels.jsonl", 1, path)
    return records.report(v.spark, path).select(F.inline("reports"))


@query("split_id_files", f"SELECT split, CAST(item_id AS VARCHAR) AS item_id FROM (SELECT *, {_SPLIT} AS split FROM {{items}}) s")
def split_id_files(v):
    path = shared.folder(v.spark, "ids")
    records.write_split_ids(_split(v), path, "item_id")
    return v.spark.read.text(path).select("split", F.col("value").alias("item_id"))


@query("split_folders", f"SELECT split, item_id, azimuth FROM (SELECT *, {_SPLIT} AS split FROM {{items}}) s")
def split_folders(v):
    path = shared.folder(v.spark, "splits")
    records.write_splits(_split(v).select("split", "item_id", "azimuth"), path)
    return v.spark.read.schema("item_id long, azimuth double, split string").json(path)


@query("summary_file", "SELECT count(*) AS items, sum(item_id) AS ids, CAST(NULL AS VARCHAR) AS skipped FROM {items}")
def summary_file(v):
    path = shared.folder(v.spark, "summary")
    records.write_json(v.items.agg(F.count("*").alias("items"), F.sum("item_id").alias("ids"), F.lit(None).cast("string").alias("skipped")), path)
    return v.spark.read.schema("items long, ids long, skipped string").json(path)


@query("training_files", "SELECT item_id, condition, condition = 'cues' AS has_cues, CASE WHEN azimuth <> 0 THEN azimuth > 0 END AS is_left FROM {items}, (SELECT unnest(['cues', 'audio_only']) AS condition) c")
def training_files(v):
    """Training examples of both conditions as packed JSON lines; only those with cues tell the level difference."""
    path = shared.folder(v.spark, "sft")
    records.write_examples(training_examples(v).withColumn("audio_path", F.lit("a.wav")), path, packed=True)
    back = v.spark.read.schema("item_id long, audio_path string, prompt string, target string, condition string").json(path)
    return back.select("item_id", "condition", F.col("prompt").contains(" dB").alias("has_cues"), (F.when(F.col("target").rlike("degrees to the left.$"), True).when(F.col("target").rlike("degrees to the right.$"), False)).alias("is_left"))


@query("embeddings_cache", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def embeddings_cache(v):
    path = shared.folder(v.spark, "embeddings")
    records.write_embeddings(v.embeddings, path)
    return records.read_embeddings(v.spark, path).select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("survey_lines", "SELECT track_id, count(*) AS windows, sum(n) AS events FROM {windows} GROUP BY track_id")
def survey_lines(v):
    """A survey a track as nested JSON, one a line."""
    path = shared.folder(v.spark, "surveys")
    nested = v.windows.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("windows"))
    records.write_surveys(nested.select(F.col("track_id").alias("track"), F.to_json(F.struct(F.col("track_id").alias("name"), "windows")).alias("survey")), path)
    back = v.spark.read.schema("name long, windows array<struct<w: long, n: long>>").json(path)
    return back.select(F.col("name").alias("track_id"), F.size("windows").cast("long").alias("windows"), F.aggregate("windows", F.lit(0).cast("long"), lambda s, w: s + w["n"]).alias("events"))


@query("chat_messages", """SELECT o_orderkey AS id, concat('[{"role":"system","content":"You listen."},{"role":"user","content":"Order ', CAST(o_orderkey AS VARCHAR), '?"}]') AS messages FROM orders""")
def chat_messages(v):
    return v.orders.select(F.col("o_orderkey").alias("id"), R.messages(F.lit("You listen."), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit("?"))).alias("messages"))


@query("parsed_lists", "SELECT o_orderkey AS id, CAST(2.0 * o_orderkey + 0.5 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS total, 3 AS n FROM orders")
def parsed_lists(v):
    """Lists of numbers as text; what is no number is null."""
    k = F.col("o_orderkey")
    parsed = C.number_list(F.concat(k.cast("string"), F.lit(", "), (k + 0.5).cast("string"), F.lit(","), F.when(k % 3 == 0, F.lit("x")).otherwise(F.lit("1"))))
    return v.orders.select(k.alias("id"), F.aggregate(parsed, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))).alias("total"), F.size(parsed).alias("n"))


@query("variant_labels", """SELECT CAST(item_id AS VARCHAR) AS item_id, CASE WHEN item_id % 7 <> 6 THEN azimuth END AS azimuth, CASE WHEN item_id % 7 <> 6 THEN instrument END AS instrument, CASE WHEN item_id % 7 < 3 THEN azimuth * 0.75 END AS ild_db, item_id % 7 = 6 AS is_bad FROM {items}""")
def variant_labels(v):
    """Label lines of three versions and broken ones, stored as variants and read by path; a broken line is kept as it stands."""
    path, k = shared.folder(v.spark, "versions"), F.col("item_id") % 7
    name, angle = F.col("item_id").cast("string").alias("item_id"), F.col("azimuth")
    top = F.to_json(F.struct(name, angle.alias("answer_azimuth_deg"), F.struct("instrument").alias("render"), F.struct((angle * 0.75).alias("ild_db")).alias("measured_evidence")))
    asked = F.to_json(F.struct(name, F.struct(angle.alias("answer_azimuth_deg")).alias("question"), "instrument"))
    listed = F.to_json(F.struct(name, F.struct(F.array(angle).alias("answer_azimuths_deg")).alias("question"), F.col("instrument"), F.lit(9).alias("version")))
    line = F.when(k < 3, top).when(k < 5, asked).when(k == 5, listed).otherwise(F.concat(F.lit('{"item_id": broken '), F.col("item_id").cast("string")))
    shared.stored(variants.records(v.items.select(line.alias("value")), "value"), "variants").write.parquet(path)
    read = v.spark.read.parquet(path)
    good = variants.labels(read.filter("bad IS NULL")).select("item_id", "azimuth", "instrument", variants.measure("evidence", "ild_db").alias("ild_db"), F.lit(False).alias("is_bad"))
    bad = read.filter("bad IS NOT NULL").select(F.regexp_extract("bad", r"broken (\d+)$", 1).alias("item_id"), F.lit(None).cast("double").alias("azimuth"), F.lit(None).cast("string").alias("instrument"), F.lit(None).cast("double").alias("ild_db"), F.lit(True).alias("is_bad"))
    return good.unionByName(bad)


@query("variant_mixtures", "SELECT CAST(item_id AS VARCHAR) AS item_id, count(*) AS sources, sum(azimuth) AS total FROM {mix_items} GROUP BY item_id")
def variant_mixtures(v):
    """Mixtures whose azimuths stand at the top or in `question`, alone or listed, from one variant column."""
    rows = v.mix_items.groupBy(F.col("item_id").cast("string").alias("item_id")).agg(F.sort_array(F.collect_list("azimuth")).alias("a"), F.max("item_id").alias("k"))
    top, one = F.col("k") % 2 == 0, F.size("a") == 1
    lists, single = F.when(~one, F.col("a")), F.when(one, F.element_at("a", 1))
    inner = F.struct(F.when(~top, lists).alias("answer_azimuths_deg"), F.when(~top, single).alias("answer_azimuth_deg"))
    text = F.to_json(F.struct("item_id", F.when(top, lists).alias("answer_azimuths_deg"), F.when(top, single).alias("answer_azimuth_deg"), inner.alias("question")))
    read = variants.mixture_labels(variants.records(rows.select(text.alias("value")), "value"))
    return read.select("item_id", F.size("azimuths").cast("long").alias("sources"), F.aggregate("azimuths", F.lit(0.0), lambda s, x: s + x).alias("total"))


_LAST = "SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'It is at 5 degrees to the left.' ELSE answer END AS answer FROM {answers}"


@query(
    "streamed_report",
    SCORED.replace("{answers}", "last_answers").replace("WITH texts AS", f"WITH last_answers AS ({_LAST}), texts AS", 1) + f"SELECT {REPORT} FROM scored",
)
def streamed_report(v):
    """Answers that come in three parts and two runs, a fourth of them again in a later part and some once more out of order; each item's last one counts."""
    source, log = shared.folder(v.spark, "arrivals"), shared.folder(v.spark, "log")
    again = v.answers.filter("item_id % 4 = 0").select("item_id", F.lit("It is at 5 degrees to the left.").alias("answer"))
    parts = [v.answers.withColumn("place", F.lit(2).cast("long")), again.withColumn("place", F.lit(3).cast("long")), v.answers.filter("item_id % 8 = 0").select("item_id", F.lit("It is at 20 degrees to the right.").alias("answer"), F.lit(1).cast("long").alias("place"))]
    for part, last in zip(parts, (True, False, True), strict=True):
        part.write.mode("append").parquet(source)
        if last:
            answers.collect(events.read(v.spark, source, "item_id long, answer string, place long"), log, f"{log}-checkpoint")
    return answers.report(v.items, log)
