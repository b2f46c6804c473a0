"""Derived tables over the driver's star schema: evaluation items, answers, evidence, signals and tracks.

Each is SQL text that Spark and DuckDB both run, built on integer arithmetic, so both engines see the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_SIDE = "CASE WHEN {0} > 0 THEN 'left' WHEN {0} < 0 THEN 'right' ELSE 'center' END"

#: In order of dependence. {name} stands for a table or an earlier view.
VIEWS: dict[str, str] = {
    "items": """SELECT o.o_orderkey AS item_id, CAST(((o.o_orderkey * 7 + o.o_custkey) % 11) * 5 - 25 AS DOUBLE) AS azimuth,
        o.o_custkey AS stem, c.c_nationkey AS piece, o.o_orderpriority AS instrument
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "answers": """SELECT item_id, CASE item_id % 6
        WHEN 0 THEN concat('The source is at ', CAST(n AS STRING), ' degrees to the ', side, '.')
        WHEN 1 THEN concat('I hear it towards the ', side, ', as the ', CAST(n AS STRING), '.0-degree azimuth shows.')
        WHEN 2 THEN 'It sounds centred in the middle.'
        WHEN 3 THEN concat('On the ', side, ' at ', CAST(n AS STRING), '.5°, I think.')
        WHEN 4 THEN 'Hard to say from this clip.'
        ELSE concat('First guess 5 degrees right. After the derivation it is ', CAST(n AS STRING), ' degrees to the ', side, '.') END AS answer
        FROM (SELECT item_id, CAST(abs(azimuth) AS BIGINT) + stem % 7 AS n,
              CASE WHEN (azimuth >= 0) <> (stem % 5 = 0) THEN 'left' ELSE 'right' END AS side
              FROM {items} WHERE item_id % 10 <> 0) x""",
    "answers_audio": """SELECT item_id, CASE item_id % 5
        WHEN 0 THEN 'Left of the Right speaker.' WHEN 1 THEN 'It is on the right.' WHEN 2 THEN 'Center, not left.'
        WHEN 3 THEN 'somewhere central' ELSE concat('the ', CASE WHEN azimuth > 0 THEN 'LEFT' ELSE 'right' END, ' side') END AS answer
        FROM {items} WHERE item_id % 4 <> 0""",
    "evidence": """SELECT item_id, azimuth, azimuth + (item_id % 5 - 2) * 1.5 AS estimated_azimuth_deg,
        azimuth * 0.75 AS ild_db, azimuth * 0.7 AS high_frequency_ild_db, CAST((item_id % 6) * 0.5 AS DOUBLE) AS ild_flatness_db, CAST((item_id % 7) * 15 AS DOUBLE) AS itd_us,
        CAST((90 + item_id % 11) * 0.01 AS DOUBLE) AS coherence,
        CASE WHEN item_id % 4 = 0 THEN NULL ELSE CAST(220 + item_id % 100 AS DOUBLE) END AS f0_hz,
        CASE WHEN (item_id % 7) * 15.0 > 30.0 THEN 'delayed' WHEN (item_id % 6) * 0.5 > 2.0 THEN 'ambiguous' ELSE 'amplitude' END AS estimated_regime,
        CAST((item_id % 9) * 0.15 AS DOUBLE) AS peak, CAST(-30 - item_id % 25 AS DOUBLE) AS rms_db
        FROM {items}""",
    "transcripts": """SELECT item_id, concat('The level difference is ', CAST(item_id % 20 AS STRING), '.', CAST(item_id % 10 AS STRING), ' dB, ', side, ' louder. ',
        CASE item_id % 3 WHEN 0 THEN 'There is no inter-channel delay. ' WHEN 1 THEN concat('Delay: ', CAST((item_id % 7) * 15 AS STRING), ' microseconds, ', side, ' channel later. ') ELSE '' END,
        CASE item_id % 4 WHEN 0 THEN concat('Coherence: 0.', CAST(90 + item_id % 10 AS STRING), '. ') WHEN 1 THEN 'The channels are highly coherent. ' WHEN 2 THEN 'They are uncorrelated. ' ELSE '' END,
        CASE item_id % 5 WHEN 0 THEN 'A binaural image, not amplitude-panned. ' WHEN 1 THEN 'This is amplitude panning. ' ELSE '' END,
        CASE WHEN item_id % 2 = 0 THEN concat('The tone is near ', CAST(220 + item_id % 90 AS STRING), ' Hz. ') ELSE 'About 440 hz. ' END,
        CASE WHEN item_id % 3 = 1 THEN concat('r = 10^(', CAST(item_id % 7 AS STRING), '.0/20) = ', CAST(1 + item_id % 2 AS STRING), '.', CAST(item_id % 10 AS STRING), '. ') ELSE '' END,
        'It is at ', CAST(CAST(abs(azimuth) AS BIGINT) + item_id % 8 AS STRING), ' degrees to the ', side, '.') AS transcript
        FROM (SELECT item_id, azimuth, CASE WHEN azimuth >= 0 THEN 'left' ELSE 'right' END AS side FROM {items}) x""",
    "stems": """SELECT p_partkey AS stem_id, p_size AS piece_id, concat('AuSep_', CAST(p_partkey % 4 + 1 AS STRING), '_', code, '_', CAST(p_size AS STRING), '_Piece', CAST(p_partkey AS STRING)) AS stem_name, code AS instrument_code,
        48000 * (2 + p_partkey % 9) AS frames, 48000 AS sample_rate
        FROM (SELECT p_partkey, p_size, CASE p_partkey % 5 WHEN 0 THEN 'vn' WHEN 1 THEN 'vc' WHEN 2 THEN 'fl' WHEN 3 THEN 'cl' ELSE 'tpt' END AS code FROM {part}) x""",
    "samples": """SELECT vec_id AS clip_id, label, pos, CAST(embedding[pos{base}] AS DOUBLE) AS l, CAST(embedding[pos + 32{base}] AS DOUBLE) AS r
        FROM (SELECT vec_id, label, embedding, {positions} AS pos FROM {embeddings}) x""",
    "mix_items": """SELECT o_custkey * 1000 + (k - 1 - (k - 1) % 5) {div} 5 AS item_id, o_orderkey AS source, CAST(((o_orderkey * 13 + o_custkey) % 11) * 5 - 25 AS DOUBLE) AS azimuth, (k - 1) % 5 + 1 AS n
        FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM {orders}) x""",
    "ensembles": """SELECT p_partkey AS stem_id, (p_partkey - p_partkey % 7) {div} 7 * 10 + CASE WHEN (p_partkey - p_partkey % 7) {div} 7 % 11 = 0 THEN 0 WHEN p_partkey % 7 < 1 THEN 1 WHEN p_partkey % 7 < 3 THEN 2 ELSE 3 END AS piece_id,
        CASE p_partkey % 5 WHEN 0 THEN 'vn' WHEN 1 THEN 'vc' WHEN 2 THEN 'fl' WHEN 3 THEN 'cl' ELSE 'tpt' END AS instrument_code, 48000 * (5 + p_partkey % 9 + p_size % 3) AS frames, 48000 AS sample_rate FROM {part}""",
    "frames": """SELECT event_id, user_id, CAST({seconds} AS BIGINT) AS t, CAST(200 + event_id % 300 AS DOUBLE) AS f0 FROM {events} WHERE event_type = 'click'""",
    "reference": """SELECT event_id, user_id, CAST({seconds} AS BIGINT) AS t, CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE CAST(210 + event_id % 300 AS DOUBLE) END AS f0 FROM {events} WHERE event_type = 'view'""",
    "windows": """SELECT user_id AS track_id, CAST(floor(CAST({seconds} AS DOUBLE) / 86400.0) AS BIGINT) AS w, avg(value * value) AS power, min(event_id) AS first_event, count(*) AS n
        FROM {events} WHERE value IS NOT NULL GROUP BY 1, 2""",
}
_SPARK = {"base": " - 1", "positions": "explode(sequence(1, 32))", "seconds": "unix_seconds(CAST(ts AS TIMESTAMP))", "div": "DIV"}
_DUCK = {"base": "", "positions": "unnest(range(1, 33))", "seconds": "floor(epoch(ts))", "div": "//"}


def _needs(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


def duck(body: str) -> str:
    """body as DuckDB SQL after the views that it names as {view}; tables by their own names."""
    wanted: set[str] = set()

    def add(text: str) -> None:
        for name in _needs(text):
            if name in VIEWS and name not in wanted:
                wanted.add(name)
                add(VIEWS[name])

    add(body)
    fill = {n: n for n in (*TABLES, *VIEWS)} | _DUCK

    def put(text: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: fill[m[1]] if m[1] in fill else m[0], text)

    views = ",\n".join(f"{n} AS ({put(VIEWS[n])})" for n in VIEWS if n in wanted)
    body = put(body).strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    return f"WITH {views},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views}\n{body}"


class Views:
    """Tables and derived views as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in VIEWS:
            text = VIEWS[name]
            for key, value in _SPARK.items():
                text = text.replace(f"{{{key}}}", value)
            found = self.spark.sql(text, **{n: getattr(self, n) for n in _needs(text) if n not in _SPARK})
        else:
            raise AttributeError(name)
        setattr(self, name, found)
        return found

    @cached_property
    def clips(self) -> DataFrame:
        """(clip_id, label, left, right): the two halves of each vector as a stereo signal."""
        from pyspark.sql import functions as F

        e = F.transform("embedding", lambda x: x.cast("double"))
        return self.embeddings.select(F.col("vec_id").alias("clip_id"), "label", F.slice(e, 1, 32).alias("left"), F.slice(e, 33, 32).alias("right"))
