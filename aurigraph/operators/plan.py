"""Deterministic expansion of an inventory into renders: splits, ids, samples and resumable work lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import numfmt as N
from .signals import spread

#: Instrument names by code.
INSTRUMENTS = {"vn": "violin", "va": "viola", "vc": "cello", "db": "double bass", "fl": "flute", "ob": "oboe", "cl": "clarinet", "sax": "saxophone", "bn": "bassoon", "tpt": "trumpet", "hn": "horn", "tbn": "trombone", "tba": "tuba"}
STEM = r"^AuSep_(\d+)_([a-z]+)_(\d+)_(.+)$"
PUBLIC = ("item_id", "split", "question_type")


def instrument_name(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in INSTRUMENTS.items() for x in pair]), code)


def parse_stems(df: DataFrame, name: str, strict: bool = True) -> DataFrame:
    """df with track, code, piece_number, piece and instrument from file names. A name of another form and a code that names no
    instrument are errors; with strict off such names go, and such instruments are null."""
    parts = {"track": (1, "int"), "code": (2, "string"), "piece_number": (3, "int"), "piece": (4, "string")}
    fits = F.col(name).rlike(STEM)
    fit = df.withColumn(name, F.when(fits, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("no name of a stem: "), F.coalesce(F.col(name), F.lit("null")))).cast("string"))) if strict else df.filter(fits)
    told = instrument_name(F.col("code"))
    if strict:
        told = F.coalesce(told, F.raise_error(F.concat(F.lit("no instrument has the code "), "code")).cast("string"))
    return fit.withColumns({k: F.regexp_extract(name, STEM, i).cast(t) for k, (i, t) in parts.items()}).withColumn("instrument", told)


def order_key(value: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), value.cast("string")), 256)


def stable_seed(value: Column, seed: int) -> Column:
    """Unsigned 64-bit number from the first 16 hex digits of sha256("seed:value")."""
    return F.conv(F.substring(order_key(value, seed), 1, 16), 16, 10).cast("decimal(20,0)")


def _share(n: Column, share: float) -> Column:
    """n * share to the nearest whole, halves to even."""
    return F.bround(n * F.lit(share)).cast("long")


def assign_splits(groups: DataFrame, key: str, seed: int, train: float = 0.70, dev: float = 0.15) -> DataFrame:
    """(key, split): the groups in hash order, cut at the shares. groups: one row for each group, far fewer than items."""
    if train < 0 or dev < 0 or train + dev > 1:
        raise ValueError("the shares of train and dev must be between 0 and 1 together")
    ranked = groups.select(key, (F.row_number().over(Window.orderBy(order_key(F.col(key), seed), key)) - 1).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
    first = _share(F.col("n"), train)
    return ranked.select(key, F.when(F.col("k") < first, "train").when(F.col("k") < first + _share(F.col("n"), dev), "dev").otherwise("test").alias("split"))


def uncovered(groups: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = groups.select(key), splits.select(key)
    return a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti"))


def render_plans(stems: DataFrame, splits: DataFrame, angles: list[float], recipes: list, clip_s: float, key: str = "piece_id", more: dict[str, Column] | None = None) -> DataFrame:
    """Stem x angle x recipe of the stems that are long enough, made where the stem is, over all cores. What hangs on angle and recipe alone
    (labels, and `more`: columns over azimuth and processing) is told once for each pair of them, in a small table that is broadcast."""
    steps = [F.array(*[F.struct(F.lit(kind).alias("kind"), F.create_map(*[F.lit(x) for p in params.items() for x in p]).cast("map<string,double>").alias("params")) for kind, params in r]).cast("array<struct<kind: string, params: map<string, double>>>") for r in recipes]
    long_enough = spread(stems).filter(F.col("frames") >= clip_s * F.col("sample_rate")).join(splits, key)
    base = F.concat(F.lit("_amp_"), N.angle_label(F.col("azimuth")), F.lit("_0ms"))
    ending = F.when(F.size("processing") == 0, base).otherwise(F.concat(base, F.lit("_"), N.processing_label(F.col("processing"))))
    pairs = stems.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, angles))).alias("azimuth")).select("azimuth", F.explode(F.array(*steps)).alias("processing"))
    grid = pairs.withColumns({"ending": ending} | (more or {}))
    return long_enough.crossJoin(F.broadcast(grid)).withColumn("render_id", F.concat(F.col("stem_id").cast("string"), "ending")).drop("ending")


def padded(number: Column, digits: int = 5) -> Column:
    """A number with zeros before it, whole where it has more digits."""
    text = number.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def opaque_ids(rows: DataFrame, key: str, seed: int, prefix: str) -> DataFrame:
    """rows with public_id, numbered in hash order so that the number tells nothing of the row.

    Numbers need one order of all rows: ranges of the hash, as many as there are shuffle partitions, are numbered apart and shifted
    by the counts of ranges before.
    """
    pieces = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed = rows.withColumn("h", order_key(F.col(key), seed)).withColumn("piece", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") * pieces / float(1 << 32)).cast("int"))
    counts = hashed.groupBy("piece").agg(F.count("*").alias("n"))
    shift = counts.select("piece", F.coalesce(F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))  # a row a range
    place = F.row_number().over(Window.partitionBy("piece").orderBy("h", key)) - 1 + F.col("shift")
    return hashed.join(F.broadcast(shift), "piece").withColumn("public_id", F.concat(F.lit(prefix), padded(place))).drop("h", "piece", "shift")


def published_id(public_id: Column, render_id: Column) -> Column:
    """The public id where there is one."""
    return F.coalesce(F.nullif(public_id, F.lit("")), render_id)


def instrument_code(name: Column) -> Column:
    """The instrument code in a stem's file name, where its range is known."""
    code = F.lower(F.regexp_extract(name, r"(?i)^AuSep_\d+_([a-z]+)_", 1))
    return F.when(code.isin(*INSTRUMENTS), code)


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by an order; an aggregate, so a hot key is combined before it moves."""
    packed = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.min_by(packed, F.struct(*order)).alias("r")).select("r.*")


def one_a_page(rows: DataFrame, page: str, order: str, key: str) -> DataFrame:
    """From each page in turn its first row whose key no earlier page has given; pages are few and short, as one listing's are."""
    pages = rows.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(order, key))).alias("rows"))
    whole = pages.agg(F.array_sort(F.collect_list(F.struct(page, "rows"))).alias("pages"))
    start = F.struct(F.array().cast(f"array<{rows.schema[key].dataType.simpleString()}>").alias("seen"), F.array().cast(f"array<{rows.schema[order].dataType.simpleString()}>").alias("taken"))

    def turn(state: Column, p: Column) -> Column:
        first = F.try_element_at(F.filter(p["rows"], lambda r: ~F.array_contains(state["seen"], r[key])), F.lit(1))
        return F.when(first.isNotNull(), F.struct(F.concat(state["seen"], F.array(first[key])).alias("seen"), F.concat(state["taken"], F.array(first[order])).alias("taken"))).otherwise(state)

    taken = whole.select(F.explode(F.aggregate("pages", start, turn, lambda s: s["taken"])).alias(order))
    return rows.join(F.broadcast(taken), order, "left_semi")


def by_ids(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of a fixed list of ids with their place in it; an id that no row has is an error."""
    wanted = F.array(*map(F.lit, ids))
    found = rows.filter(F.col(key).isin(ids)).withColumn("place", F.array_position(wanted, F.col(key)).cast("int"))
    if (n := found.select(key).distinct().count()) < len(set(ids)):
        raise KeyError(f"{len(set(ids)) - n} of the ids are not there")
    return found


def stems_by_piece(stems: DataFrame, key: str = "piece_id") -> DataFrame:
    """(piece, stems): each piece's (code, stem) in order."""
    return stems.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("instrument_code").alias("code"), "stem_id"))).alias("stems"))


def question(render_id: Column, instrument: Column, azimuth: Column) -> list[Column]:
    return [F.concat(render_id, F.lit("_absolute")).alias("question_id"), F.concat(F.lit("Where is the "), instrument, F.lit(" positioned in the stereo image? Return its side and azimuth in degrees.")).alias("question"), G.side(azimuth).alias("answer_side")]


def answerable_azimuth(azimuth: Column, processing: Column, regime: Column) -> Column:
    """What a question asks for: the azimuth after processing; an error where that is lost. A binaural render has its own."""
    after = G.expected_cues(azimuth, processing)["azimuth_deg"]
    lost = F.raise_error(F.lit("no azimuth can be recovered after this processing")).cast("double")
    return F.when(regime == "binaural", azimuth).otherwise(F.coalesce(after, lost))


def public(rows: DataFrame) -> DataFrame:
    """What may be published of test items: no answer, no evidence."""
    return rows.select(*PUBLIC)


def first_loud(rows: DataFrame, attempts: int, loud: Callable[[Column], Column]) -> DataFrame:
    """rows with the first attempt that is loud, else the last."""
    found = F.filter(F.sequence(F.lit(0), F.lit(attempts - 1)), loud)
    return rows.withColumn("attempt", F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(attempts - 1)))


def every_nth(rows: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """Every n-th row by key, as many as `most`: the first n * most rows are all it needs, so the order is a top-k."""
    first = rows.orderBy(key).limit(n * most)
    return first.withColumn("k", F.row_number().over(Window.orderBy(key)) - 1).filter(F.col("k") % n == 0).drop("k")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(order_key(F.col(key), seed), key).limit(n)


def shuffle_within(rows: DataFrame, group: str, key: str, value: str, seed: int) -> DataFrame:
    """rows with `shuffled`: the group's values dealt anew by hash order, a null control."""
    ordered = rows.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(key)))
    dealt = rows.select(group, F.col(value).alias("shuffled"), F.row_number().over(Window.partitionBy(group).orderBy(order_key(F.col(key), seed), key)).alias("k"))
    return ordered.join(dealt, [group, "k"]).drop("k")


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key), key, "left_anti")


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; an aggregate, so a hot key is combined before it moves."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(packed, F.col(order)).alias("r")).select("r.*")


def mixture_groups(stems: DataFrame, clip_s: float, key: str = "piece_id") -> DataFrame:
    """Groups of 2 to 5 stems that are all long enough are planned, larger or shorter ones skipped, single stems dropped."""
    groups = stems.groupBy(key).agg(F.count("*").alias("n"), F.min(F.col("frames") / F.col("sample_rate")).alias("shortest"))
    return groups.withColumn("status", F.when(F.col("n") < 2, "dropped").when((F.col("n") > 5) | (F.col("shortest") < clip_s), "skipped").otherwise("planned"))
