"""Claims in free text: azimuths, level differences, delays, coherence, regime, pitch and premises; Column in, Column out.

Spans are 0-based and end-exclusive. They come from the matches and the pieces between them, which Catalyst can list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far from a number its side may stand, and the patterns of the claims.
WINDOW = 60
NUMBER = r"\d+(?:\.\d+)?"
UNIT = r"(?:degrees?|°)"
ADJACENT = rf"(?i){NUMBER}\s*{UNIT}\s*(?:to the\s+)?(?:left|right)"
BARE = rf"(?i){NUMBER}[\s-]*{UNIT}"
EITHER = rf"(?i){NUMBER}[\s-]*{UNIT}(?:\s*(?:to the\s+)?(?:left|right))?"
SIDE = r"(?i)\b(left|right)\b"
CENTRE = r"(?i)\bcent(?:er|re|red)\b"
DECIBEL = rf"(?i){NUMBER}\s*dB\b"
MICROSECOND = rf"(?i){NUMBER}\s*microseconds?\b"
NO_DELAY = r"(?i)\bno\s+(?:inter-?channel\s+)?delay\b"
LATER = r"(?i)\b(left|right)\b\s+channel\s+later"
COHERENCE = rf"(?i)coherence\D{{0,20}}?({NUMBER})"
COHERENCE_WORDS = (("no coherence", 0.0), ("not coherent", 0.0), ("decorrelated", 0.0), ("uncorrelated", 0.0), ("highly coherent", 1.0), ("perfectly coherent", 1.0), ("fully coherent", 1.0))
DELAYED = r"(?i)\bbinaural\b|genuinely delayed|time-delay|time delay|delayed regime"
AMPLITUDE = r"(?i)amplitude[-\s]panned|amplitude panning|amplitude regime"
HERTZ = rf"({NUMBER})\s*Hz\b"
PREMISE = rf"(?i)r\s*=\s*10\^\(\s*(-?{NUMBER})\s*/\s*20\s*\)\s*=\s*({NUMBER})"
SENTENCE = r"[^.!?]+[.!?]"
ANSWER_LEVEL = r"level difference is\s*(-?\d+(?:\.\d+)?)\s*dB"
ANSWER_AZIMUTH = r"azimuth\s*=\s*arctan\([^)]*\)\s*=\s*(-?\d+(?:\.\d+)?)"
STATED = r"(?i)\b(left|right|center|centre)\b"


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def group(text: Column, pattern: str, n: int) -> Column:
    """A group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, match: string>>").alias("out"))

    def add(s: Column, pair: Column) -> Column:
        first = s["at"] + F.length(pair["between"])
        last = first + F.length(pair["match"])
        return F.struct(last.alias("at"), F.concat(s["out"], F.array(F.struct(first.alias("start"), last.alias("end"), pair["match"].alias("match")))).alias("out"))

    pairs = F.arrays_zip(let(between, lambda b: F.slice(b, 1, F.size(b) - 1)).alias("between"), matches.alias("match"))
    return F.aggregate(pairs, start, add, lambda s: s["out"])


def first_span(text: Column, pattern: str) -> Column:
    """The first of spans(), or null; without listing the others. No pattern here matches the empty text."""
    match = F.regexp_extract(text, pattern, 0)
    start = F.length(F.split(text, pattern, 2)[0])
    return F.when(match != "", F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match")))


def near(text: Column, span: Column) -> Column:
    """The text from WINDOW characters before a span to as many after it."""
    first = F.greatest(span["start"] - WINDOW, F.lit(0))
    return F.substring(text, first + 1, span["end"] + WINDOW - first)


def _number(match: Column) -> Column:
    return F.regexp_extract(match, f"({NUMBER})", 1).cast("double")


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def azimuth_claims(text: Column) -> Column:
    """array<struct<start, end, magnitude, side>> in order: numbers with a side right after them, and other numbers of degrees
    with the first side word in their window. One scan finds both; texts without the unit are not searched."""

    def claim(s: Column) -> Column:
        beside = F.regexp_like(s["match"], F.lit(rf"^{ADJACENT}$"))
        bare = F.struct(s["start"].alias("start"), (s["start"] + F.length(F.regexp_extract(s["match"], BARE, 0))).alias("end"))
        said = F.when(beside, F.lower(F.regexp_extract(s["match"], r"(?i)(left|right)$", 1))).otherwise(F.lower(group(near(text, bare), SIDE, 1)))
        return F.struct(s["start"].alias("start"), F.when(beside, s["end"]).otherwise(bare["end"]).alias("end"), _number(s["match"]).alias("magnitude"), said.alias("side"))

    found = F.filter(F.transform(spans(text, EITHER), claim), lambda c: c["side"].isNotNull())
    none = F.array().cast("array<struct<start: int, end: int, magnitude: double, side: string>>")
    return F.when(F.contains(F.lower(text), F.lit("degree")) | F.contains(text, F.lit("°")), found).otherwise(F.when(text.isNotNull(), none))


def final_azimuth(text: Column, claims: Column | None = None) -> Column:
    """struct<start, end, magnitude, side> of the last claim, or of the first word for the centre, or null."""
    claims = azimuth_claims(text) if claims is None else claims
    centre = let(first_span(text, CENTRE), lambda c: F.when(c.isNotNull(), F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(0.0).alias("magnitude"), F.lit("center").alias("side"))))
    return F.coalesce(F.try_element_at(claims, F.lit(-1)), centre)


def signed(claim: Column) -> Column:
    """Left positive, right negative, centre 0."""
    return let(claim, lambda c: F.when(c["side"] == "left", c["magnitude"]).when(c["side"] == "right", 0.0 - c["magnitude"]).when(c["side"] == "center", 0.0))


def signed_azimuth(text: Column) -> Column:
    return signed(final_azimuth(text))


def signed_azimuths(text: Column) -> Column:
    return F.transform(azimuth_claims(text), signed)


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def ild_claim(text: Column) -> Column:
    """struct<start, end, value>: the first dB figure whose window says which side is louder."""
    seen = F.transform(spans(text, DECIBEL), lambda s: F.struct(s["start"], s["end"], _number(s["match"]).alias("n"), F.lower(group(near(text, s), SIDE, 1)).alias("side"), F.contains(F.lower(near(text, s)), F.lit("louder")).alias("louder")))
    hits = F.filter(seen, lambda s: s["louder"] & s["side"].isNotNull())
    return let(_first(hits), lambda hit: _of(hit, F.when(hit["side"] == "left", hit["n"]).otherwise(-hit["n"])))


def itd_claim(text: Column) -> Column:
    def value(hit: Column) -> Column:
        return F.when(F.lower(group(near(text, hit), LATER, 1)) == "left", -_number(hit["match"])).otherwise(_number(hit["match"]))

    none = let(first_span(text, NO_DELAY), lambda hit: _of(hit, F.lit(0.0)))
    return F.coalesce(none, let(first_span(text, MICROSECOND), lambda hit: _of(hit, value(hit))))


def _of(span: Column, value: Column) -> Column:
    return F.when(span.isNotNull(), F.struct(span["start"].alias("start"), span["end"].alias("end"), value.alias("value")))


def coherence_claim(text: Column) -> Column:
    stated = let(first_span(text, COHERENCE), lambda hit: _of(hit, F.regexp_extract(hit["match"], COHERENCE, 1).cast("double")))

    def as_word(word: str, value: float) -> Column:
        return let(first_span(text, rf"(?i)\b{word}\b"), lambda hit: _of(hit, F.lit(value)))

    words = [as_word(*pair) for pair in COHERENCE_WORDS]
    return F.coalesce(stated, *words)


def regime_claim(text: Column) -> Column:
    return F.coalesce(let(first_span(text, DELAYED), lambda hit: _of(hit, F.lit("delayed"))), let(first_span(text, AMPLITUDE), lambda hit: _of(hit, F.lit("amplitude"))))


def f0_claim(text: Column) -> Column:
    """Hz in this very case."""
    return let(first_span(text, HERTZ), lambda hit: _of(hit, _number(hit["match"])))


def premise_claim(text: Column) -> Column:
    """struct<start, end, x, y> of r = 10^(x/20) = y."""

    def parts(hit: Column) -> Column:
        x, y = (F.regexp_extract(hit["match"], PREMISE, i).cast("double") for i in (1, 2))
        return F.when(hit.isNotNull(), F.struct(hit["start"].alias("start"), hit["end"].alias("end"), x.alias("x"), y.alias("y")))

    return let(first_span(text, PREMISE), parts)


def unparsed_sentences(text: Column, consumed: Column) -> Column:
    """Sentences with a digit that overlap no consumed span; points in numbers end sentences as well."""
    open_ones = F.filter(spans(text, SENTENCE), lambda s: F.regexp_like(s["match"], F.lit(r"\d")) & ~F.exists(consumed, lambda c: _overlap(s, c)))
    return F.transform(open_ones, lambda s: F.regexp_replace(s["match"], r"^\s+|\s+$", ""))


def stated_side(text: Column) -> Column:
    """The first side word, with both spellings of the centre as center."""
    word = F.lower(group(text, STATED, 1))
    return F.when(word == "centre", "center").otherwise(word)


def answer_pair(text: Column) -> Column:
    """struct<level, azimuth> that a derived answer states; null unless it has both."""
    level, azimuth = (group(text, p, 1).cast("double") for p in (ANSWER_LEVEL, ANSWER_AZIMUTH))
    return F.when(level.isNotNull() & azimuth.isNotNull(), F.struct(level.alias("level"), azimuth.alias("azimuth")))
