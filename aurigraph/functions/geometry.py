"""Closed forms of spatial hearing and of the processing that moves a source; Column in, Column out.

Positive azimuths, level differences and delays mean left (louder left, later right channel).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speaker angle, head radius in metres, speed of sound in m/s.
SPEAKER_DEG = 30.0
HEAD_M = 0.0875
SOUND_M_S = 343.0
_TAN = math.tan(math.radians(SPEAKER_DEG))
_MAX_ITD_US = HEAD_M / SOUND_M_S * (math.pi / 2 + 1) * 1e6


def _nan_safe(x: Column) -> Column:
    """NaN as null, so that no comparison with it holds."""
    return F.when(~F.isnan(x), x)


def side(x: Column) -> Column:
    x = _nan_safe(x)
    return F.when(x > 0, "left").when(x < 0, "right").otherwise("center")


def coordinate(azimuth: Column) -> Column:
    """Panning coordinate, -1 to 1 between the speakers."""
    return F.tan(F.radians(azimuth)) / _TAN


def azimuth_of(d: Column) -> Column:
    return F.degrees(F.atan(d * _TAN))


def pan_gains(azimuth: Column) -> tuple[Column, Column]:
    """Constant-power gains of the left and right channel."""
    d = coordinate(azimuth)
    left, right = (1 + d) / 2, (1 - d) / 2
    power = F.sqrt(left * left + right * right)
    return left / power, right / power


def ild_of_azimuth(azimuth: Column) -> Column:
    """Level difference in dB; an error at or beyond the speakers."""
    d = coordinate(azimuth)
    return F.when(F.abs(azimuth) >= SPEAKER_DEG, F.raise_error(F.lit("azimuth is not between the speakers")).cast("double")).otherwise(20 * F.log10((1 + d) / (1 - d)))


def azimuth_of_ild(ild: Column) -> Column:
    r = F.pow(F.lit(10.0), ild / 20)
    return azimuth_of((r - 1) / (r + 1))


def woodworth_us(azimuth: Column) -> Column:
    theta = F.radians(azimuth)
    return (theta + F.sin(theta)) * (HEAD_M / SOUND_M_S * 1e6)


def azimuth_of_itd(itd_us: Column, margin_us: float = 100.0, steps: int = 24) -> Column:
    """Newton's iteration on theta + sin(theta); null beyond the largest delay by more than the margin, clipped within it."""
    clipped = F.greatest(F.lit(-_MAX_ITD_US), F.least(F.lit(_MAX_ITD_US), itd_us))
    k = clipped * 1e-6 * (SOUND_M_S / HEAD_M)
    # at a right angle the slope is 1, so the iteration is safe on the whole range
    theta = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), k / 2, lambda t, _: F.greatest(F.lit(-math.pi / 2), F.least(F.lit(math.pi / 2), t - (t + F.sin(t) - k) / (1 + F.cos(t)))))
    return F.when(F.abs(itd_us) <= _MAX_ITD_US + margin_us, F.degrees(theta))


def head_shadow_db(frequency: Column, azimuth: Column) -> Column:
    return -20 * F.abs(F.sin(F.radians(azimuth))) * frequency / (frequency + 1500)


def azimuth_after_width(azimuth: Column, width: Column) -> Column:
    """Null where the width drives the source beyond a speaker."""
    d = coordinate(azimuth) * width
    return F.when(F.abs(d) <= 1, azimuth_of(d))


def peaking_eq(rate: float, center_hz: Column, gain_db: Column, q: Column) -> dict[str, Column]:
    """Normalised biquad coefficients."""
    a, w = F.pow(F.lit(10.0), gain_db / 40), center_hz * (2 * math.pi / rate)
    alpha = F.sin(w) / (2 * q)
    a0 = 1 + alpha / a
    return {"b0": (1 + alpha * a) / a0, "b1": -2 * F.cos(w) / a0, "b2": (1 - alpha * a) / a0, "a1": -2 * F.cos(w) / a0, "a2": (1 - alpha / a) / a0}


def gain_reduction_db(level: Column, threshold: Column | float, ratio: Column | float) -> Column:
    return F.greatest(level - threshold, F.lit(0.0)) * (1 - 1 / F.lit(ratio) if isinstance(ratio, (int, float)) else 1 - 1 / ratio)


def regime(itd_us: Column, flatness_db: Column) -> tuple[Column, Column]:
    """Label and confidence."""
    delayed, uneven = F.abs(_nan_safe(itd_us)) > 30, _nan_safe(flatness_db) > 2
    label = F.when(delayed, "delayed").when(uneven, "ambiguous").otherwise("amplitude")
    return label, F.when(delayed & uneven, 1.0).when(delayed, 0.75).when(uneven, 0.5).otherwise(1.0)


def expected_cues(azimuth: Column, processing: Column) -> Column:
    """What the cues of a source should be after a chain of steps array<struct<kind, params map>>: a struct of azimuth_deg,
    itd_us, regime, coherence_stays_high. Width rescales the coordinate, a delay sets delay and regime, wet reverb leaves neither
    azimuth nor regime; compression and equalisation change nothing; an unknown kind is an error."""
    start = F.struct(azimuth.alias("azimuth_deg"), F.lit(0.0).alias("itd_us"), F.lit("amplitude").alias("regime"), F.lit(True).alias("coherence_stays_high"))
    start = start.cast("struct<azimuth_deg: double, itd_us: double, regime: string, coherence_stays_high: boolean>")  # all may become null

    def step(s: Column, p: Column) -> Column:
        def value(name: str) -> Column:
            return F.try_element_at(p["params"], F.lit(name))

        def state(azimuth: Column = s["azimuth_deg"], itd: Column = s["itd_us"], regime: Column = s["regime"], high: Column = s["coherence_stays_high"]) -> Column:
            return F.struct(azimuth.alias("azimuth_deg"), itd.alias("itd_us"), regime.alias("regime"), high.alias("coherence_stays_high"))

        kind, delay = p["kind"], value("delay_us")
        return (
            F.when(kind.isin("compression", "eq"), s)
            .when(kind == "midside", state(azimuth=azimuth_after_width(s["azimuth_deg"], value("width"))))
            .when(kind == "delay_widening", state(itd=delay, regime=F.when(delay != 0, F.lit("delayed")).otherwise(s["regime"])))
            .when((kind == "reverb") & (F.coalesce(value("wet"), F.lit(0.0)) == 0), s)
            .when(kind == "reverb", state(azimuth=F.lit(None).cast("double"), regime=F.lit(None).cast("string"), high=F.lit(False)))
            .otherwise(F.struct(F.raise_error(F.concat(F.lit("unknown processing kind: "), kind)).cast("double").alias("azimuth_deg"), s["itd_us"].alias("itd_us"), s["regime"].alias("regime"), s["coherence_stays_high"].alias("coherence_stays_high")))
        )

    return F.aggregate(processing, start, step)


def log_mel_offset(ild_db: Column) -> Column:
    """By how much a level difference moves log-mel features in which four decades of power are one unit."""
    return ild_db / 10 / 4
