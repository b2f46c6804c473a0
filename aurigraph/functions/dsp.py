"""Signal kernels in NumPy: what higher-order functions can't express at speed. One clip in, one result out.

Signals are float arrays; stereo is (left, right). Positive level differences and delays mean left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Fixed values of the cue estimators.
LEVEL_SEGMENT, ACTIVE_DB = 4096, -60.0
BANDS_HZ = (125.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0)
HIGH_HZ = 2000.0
COHERENCE_HZ = (80.0, 8000.0)
MAX_ITD_US = 700.0
HEAD_M, SOUND_M_S = 0.0875, 343.0
#: Fixed values of the reverb: comb and allpass delays in samples at 44.1 kHz, damping, allpass gain, spread of the right channel.
COMBS = (1116, 1188, 1277, 1356, 1422, 1491, 1557, 1617)
ALLPASSES = (556, 441, 341, 225)
DAMPING, ALLPASS_GAIN, SPREAD = 0.25, 0.5, 23
#: Beyond so many samples a reverb runs its filters instead of keeping what they make of a click.
LONGEST_KEPT = 1 << 20
#: Fixed values of the pitch tracker, and how strong the peak of a delay must be to be relied on.
PITCH_RATE, HOP_S, SILENCE_DB, TROUGH = 24_000, 0.01, -60.0, 0.15
RELIABLE = 0.05
#: f0 in Hz that instruments reach, by code, and that is looked for in a mix.
RANGES_HZ = {
    "vn": (185.00, 2637.02), "va": (123.47, 1396.91), "vc": (61.74, 1046.50), "db": (36.71, 246.94), "fl": (246.94, 2489.02), "ob": (220.00, 1864.66), "cl": (138.59, 1975.53),
    "sax": (123.47, 932.33), "bn": (55.00, 659.26), "tpt": (155.56, 1244.51), "hn": (58.27, 739.99), "tbn": (77.78, 698.46), "tba": (34.65, 369.99),
}
MIX_RANGE_HZ = (55.0, 1000.0)
KINDS = ("compression", "eq", "midside", "delay_widening", "reverb")


#: Cues that are told from levels, and from the delay.
LEVEL_CUES = ("ild_db", "high_frequency_ild_db", "ild_flatness_db", "estimated_azimuth_deg", "active_bins")
DELAY_CUES = ("itd_us", "itd_peak_strength", "binaural_azimuth_deg")


class Unusable(ValueError):
    """The signal is too short, silent, not finite or of the wrong shape."""


def checked(left: np.ndarray, right: np.ndarray, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    left, right = np.asarray(left, float), np.asarray(right, float)
    if left.shape != right.shape or left.ndim != 1 or len(left) < least:
        raise Unusable("two channels of equal length are needed")
    ends = [float(e) for x in (left, right) for e in (x.min(), x.max())]  # NaN is either of them where there is one
    if not all(map(math.isfinite, ends)):
        raise Unusable("a sample is not finite")
    if max(map(abs, ends)) <= np.finfo(float).eps:
        raise Unusable("the signal is silent")
    return left, right


@lru_cache(maxsize=16)
def hann(n: int) -> np.ndarray:
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    w.setflags(write=False)
    return w


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.as_strided(x, ((len(x) - size) // hop + 1, size), (hop * x.strides[0], x.strides[0]), writeable=False)


def spectra(x: np.ndarray, size: int) -> np.ndarray:
    """(frames, bins), half overlapping, neither extended nor padded."""
    return np.fft.rfft(frames(x, size, size - size // 2) * hann(size), axis=1)


def _energy(spectra: np.ndarray) -> np.ndarray:
    """Squared magnitudes of each bin, added up over frames."""
    parts = np.ascontiguousarray(spectra).view(float)
    return np.einsum("ij,ij->j", parts, parts).reshape(-1, 2).sum(1)


def _median(x: np.ndarray) -> float:
    """np.median of finite numbers, which takes longer to look around than to count."""
    x, half = np.sort(x), len(x) // 2
    return float(x[half] if len(x) % 2 else (x[half - 1] + x[half]) / 2)


def active_bins(left: np.ndarray, right: np.ndarray, rate: int, per_frame: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, left and right magnitudes of the bins within 60 dB of the strongest one."""
    left, right = checked(left, right)
    size = min(LEVEL_SEGMENT, len(left))
    a, b = spectra(left, size), spectra(right, size)
    a, b = (np.abs(x) if per_frame else np.sqrt(_energy(x) / len(x))[None] for x in (a, b))
    frequency = np.broadcast_to(np.fft.rfftfreq(size, 1 / rate), a.shape)
    strength = np.hypot(a, b)
    tiny = np.finfo(float).tiny
    on = (strength >= strength.max() * 10 ** (ACTIVE_DB / 20)) & (a > tiny) & (b > tiny)
    return frequency[on], a[on], b[on]


def azimuth_of_ild(ild: float | np.ndarray) -> float | np.ndarray:
    r = 10 ** (np.asarray(ild) / 20)
    return np.degrees(np.arctan((r - 1) / (r + 1) * math.tan(math.radians(30))))


def level_cues(left: np.ndarray, right: np.ndarray, rate: int) -> dict:
    frequency, a, b = active_bins(left, right, rate)
    if not len(a):
        raise Unusable("no bin is active in both channels")
    ild = 20 * np.log10(a / b)
    whole = _median(ild)
    high = ild[np.searchsorted(frequency, HIGH_HZ) :]
    bands = zip(*np.searchsorted(frequency, [[c / math.sqrt(2) for c in BANDS_HZ], [c * math.sqrt(2) for c in BANDS_HZ]]))
    medians = [_median(ild[i:j]) for i, j in bands if i < j]
    return {"ild_db": whole, "high_frequency_ild_db": _median(high) if len(high) else whole, "ild_flatness_db": float(np.std(medians)) if len(medians) > 1 else 0.0, "estimated_azimuth_deg": float(azimuth_of_ild(whole)), "active_bins": int(len(ild))}


def instrument_range(code: str) -> tuple[float, float]:
    try:
        return RANGES_HZ[code.strip().lower()]
    except KeyError:
        raise ValueError(f"no range is known of instrument {code!r}") from None


def _vertex(y: np.ndarray) -> float:
    """Where the parabola through three neighbouring values has its extreme, from the middle one."""
    slope, bend = (y[2] - y[0]) / 2, y[0] + y[2] - 2 * y[1]
    return -slope / bend if bend else 0.0


def delay_us(left: np.ndarray, right: np.ndarray, rate: int, most_us: float = MAX_ITD_US) -> tuple[float, float]:
    """Delay of the right channel by phase-only cross-correlation, refined by a parabola, and the peak's share of all values."""
    left, right = checked(left, right)
    size = 1 << (2 * len(left) - 1).bit_length()
    product = np.fft.rfft(right - right.mean(), size) * np.fft.rfft(left - left.mean(), size).conj()
    size_of = np.abs(product)
    product[size_of <= 1e-12 * size_of.max()] = 0
    np.divide(product, size_of, out=product, where=size_of > 0)
    reach = math.ceil(most_us * 1e-6 * rate)
    whole = np.fft.irfft(product, size)
    near = np.concatenate([whole[-reach:], whole[: reach + 1]])  # lags -reach to reach
    top = int(near.argmax())
    inner = 0 < top < 2 * reach
    lag = top - reach + (_vertex(near[top - 1 : top + 2]) if inner else 0.0)
    return lag / rate * 1e6, float(abs(near[top]) / max(np.abs(near).sum(), np.finfo(float).tiny))


def reliable(peak_strength: float) -> bool:
    return peak_strength > RELIABLE


def coherence_segment(n: int) -> int:
    """Segment length for at least 32 half-overlapping segments of 256 to 4096 samples."""
    size = min(4096, 2 * n // 33)
    if size < 256:
        raise Unusable("too short for an estimate of coherence")
    return size


def coherence(left: np.ndarray, right: np.ndarray, rate: int) -> float:
    """Median magnitude-squared coherence of 80 to 8000 Hz, averaged over segments without their means."""
    left, right = checked(left, right)
    size = coherence_segment(len(left))
    frequency = np.fft.rfftfreq(size, 1 / rate)
    band = slice(np.searchsorted(frequency, COHERENCE_HZ[0]), np.searchsorted(frequency, COHERENCE_HZ[1], "right"))
    a, b = (np.fft.rfft((f - f.mean(1, keepdims=True)) * hann(size), axis=1)[:, band] for f in (frames(x, size, size - size // 2) for x in (left, right)))
    cross = np.einsum("ij,ij->j", a, b.conj()) / len(a)
    power = _energy(a) / len(a) * (_energy(b) / len(a))
    with np.errstate(divide="ignore", invalid="ignore"):
        values = np.abs(cross) ** 2 / power
    values = values[np.isfinite(values)]
    if not len(values):
        raise Unusable("no finite coherence in the band")
    return _median(values)


def azimuth_of_delay(itd_us: float) -> float:
    """Inverse of the spherical-head relation; NaN beyond its largest delay by more than 100 us."""
    most = HEAD_M / SOUND_M_S * (math.pi / 2 + 1) * 1e6
    if not abs(itd_us) <= most + 100:
        return math.nan
    k = max(-most, min(most, itd_us)) * 1e-6 * SOUND_M_S / HEAD_M
    theta = k / 2
    for _ in range(24):
        theta = max(-math.pi / 2, min(math.pi / 2, theta - (theta + math.sin(theta) - k) / (1 + math.cos(theta))))
    return math.degrees(theta)


def regime(itd_us: float, flatness_db: float) -> str:
    return "delayed" if abs(itd_us) > 30 else "ambiguous" if flatness_db > 2 else "amplitude"


def measure(left: np.ndarray, right: np.ndarray, rate: int, f0: tuple[float, float] | None = None, cues: tuple[str, ...] | None = None) -> dict:
    """All cues of a clip, or no more than `cues` need; f0: the range of its instrument, to have its pitch tracked too."""

    def asked(*names: str) -> bool:
        return cues is None or any(name in cues for name in names)

    found, pitch = {}, math.nan
    if asked("estimated_regime", *LEVEL_CUES):
        found |= level_cues(left, right, rate)
    if asked("estimated_regime", *DELAY_CUES):
        itd, strength = delay_us(left, right, rate)
        found |= {"itd_us": itd, "itd_peak_strength": strength, "binaural_azimuth_deg": azimuth_of_delay(itd)}
    if asked("estimated_regime"):
        found["estimated_regime"] = regime(found["itd_us"], found["ild_flatness_db"])
    if f0 is not None and asked("f0_hz"):
        try:
            track, voiced = pitch_track((np.asarray(left, float) + right) / 2, rate, *f0)
            pitch = float(np.median(track[voiced])) if voiced.any() else math.nan
        except Unusable:
            pass
    if asked("coherence"):
        found["coherence"] = coherence(left, right, rate)
    return found | {"f0_hz": pitch}


def resample(x: np.ndarray, rate: int, to: int, half: int = 32) -> np.ndarray:
    """Windowed-sinc resampling. Places between samples repeat, so there is one kernel for each of them."""
    x = np.asarray(x, float)
    if rate == to:
        return x
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    cut = min(1.0, to / rate)
    width = math.ceil(half / cut)
    apart = np.arange(up)[:, None] / up + np.arange(width - 1, -width - 1, -1)[None, :]
    kernels = cut * np.sinc(cut * apart) * np.where(np.abs(apart) < width, 0.5 + 0.5 * np.cos(np.pi * apart / width), 0)
    places = np.arange(math.ceil(len(x) * to / rate)) * down
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(width - 1), x, np.zeros(width + 1)]), 2 * width)
    if up == 1:
        return windows[places] @ kernels[0]
    return np.einsum("ij,ij->i", windows[places // up], kernels[places % up])


def pitch_track(x: np.ndarray, rate: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(f0, voiced) each 10 ms by YIN: the cumulative-mean-normalised difference, its first dip below a threshold, a parabola.

    All frames at once, in blocks. Frames 60 dB below the loudest are unvoiced. Unvoiced f0 is NaN.
    """
    x = resample(x, rate, PITCH_RATE)
    size = 1 << max(11, math.ceil(math.log2(4 * PITCH_RATE / low)))
    if len(x) < size or high >= PITCH_RATE / 2:
        raise Unusable("too short or out of range for a pitch")
    hop, longest, shortest = int(HOP_S * PITCH_RATE), math.ceil(PITCH_RATE / low) + 1, max(2, int(PITCH_RATE / high))
    parts = frames(x, size, hop)
    rms = np.sqrt(np.mean(parts**2, axis=1))
    f0 = np.full(len(parts), math.nan)
    loud = np.flatnonzero((rms > 0) & (rms >= rms.max() * 10 ** (SILENCE_DB / 20)))
    for start in range(0, len(loud), 256):
        some = loud[start : start + 256]
        f0[some] = _periods(parts[some], longest, shortest)
    voiced = np.isfinite(f0) & (f0 >= low * 0.97) & (f0 <= high * 1.03)
    return np.where(voiced, f0, math.nan), voiced


def _periods(parts: np.ndarray, longest: int, shortest: int) -> np.ndarray:
    """f0 of each frame, NaN where no dip is deep enough."""
    rows, size = parts.shape
    window, n = size - longest, 2 * size
    same = np.fft.irfft(np.fft.rfft(parts[:, :window], n).conj() * np.fft.rfft(parts, n), n)[:, : longest + 1]
    power = np.concatenate([np.zeros((rows, 1)), np.cumsum(parts**2, axis=1)], axis=1)
    d = np.maximum(power[:, window : window + 1] + (power[:, window : window + longest + 1] - power[:, : longest + 1]) - 2 * same, 0)
    mean = np.cumsum(d[:, 1:], axis=1)
    normal = np.ones((rows, longest + 1))
    np.divide(d[:, 1:] * np.arange(1, longest + 1), mean, out=normal[:, 1:], where=mean > 0)
    out = np.full(rows, math.nan)
    for i, below in enumerate(normal[:, shortest:longest] < TROUGH):
        if not below.any():
            continue
        k = int(below.argmax()) + shortest
        row = normal[i]
        while k + 1 < longest and row[k + 1] < row[k]:
            k += 1
        out[i] = PITCH_RATE / (k + _vertex(row[k - 1 : k + 2]))
    return out


def tone(f: float, rate: int, seconds: float, partials: int = 6) -> np.ndarray:
    """Harmonics of falling strength, to a peak of 1."""
    t = np.arange(round(seconds * rate)) / rate
    x = sum(np.sin(2 * np.pi * k * f * t) / k for k in range(1, partials + 1))
    return x / np.abs(x).max()


def faded(x: np.ndarray, rate: int, seconds: float = 0.01) -> np.ndarray:
    """x with raised-cosine ends."""
    n = min(round(seconds * rate), len(x) // 2)
    if n < 2:
        return x
    ramp = 0.5 - 0.5 * np.cos(np.pi * np.arange(n) / n)
    return np.concatenate([x[:n] * ramp, x[n : len(x) - n], x[len(x) - n :] * ramp[::-1]])


def notes(pitches: list[float], rate: int, seconds: float = 0.5, gap: float = 0.1, guard: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tones with silence after each, and the truth each 10 ms: times and f0, 0 in silences and near the ends of notes."""
    if not pitches or seconds <= 0 or gap < 0:
        raise ValueError("notes need a pitch each and a duration")
    whole, step = np.zeros(round(gap * rate)), round(seconds * rate) + round(gap * rate)
    audio = np.concatenate([np.concatenate([faded(0.5 * tone(f, rate, seconds), rate), whole]) for f in pitches])
    times = np.arange(math.floor(len(audio) / rate / HOP_S)) * HOP_S
    number = np.minimum((times * rate / step).astype(int), len(pitches) - 1)
    into = times - number * step / rate
    sounding = (into >= guard) & (into <= seconds - guard)
    return audio, times, np.where(sounding, np.array(pitches, float)[number], 0.0)


def glide(start_hz: float, end_hz: float, seconds: float, rate: int, partials: int = 6, guard: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tone whose pitch moves evenly in octaves, and the truth each 10 ms: times and f0."""
    if min(start_hz, end_hz, seconds) <= 0:
        raise ValueError("a glide needs two pitches and a duration")
    t = np.arange(round(seconds * rate)) / rate
    turns = 2 * np.pi * np.cumsum(start_hz * (end_hz / start_hz) ** (t / seconds)) / rate
    count = max(1, min(partials, int((rate / 2 - 1e-9) // max(start_hz, end_hz))))
    x = sum(np.sin(k * turns) / k for k in range(1, count + 1))
    times = np.arange(math.floor(seconds / HOP_S)) * HOP_S
    truth = start_hz * (end_hz / start_hz) ** (times / seconds)
    return faded(0.5 * x / np.abs(x).max(), rate), times, np.where((times >= guard) & (times <= seconds - guard), truth, 0.0)


def decorrelated(x: np.ndarray, ratio: float, rng: np.random.Generator) -> np.ndarray:
    """Noise with the spectrum of x and random phases, of `ratio` times its power."""
    if ratio < 0 or len(x) < 2:
        raise ValueError("noise needs a signal and a share that is not negative")
    if ratio == 0:
        return np.zeros(len(x))
    spectrum = np.fft.rfft(x)
    turned = np.abs(spectrum) * np.exp(2j * np.pi * rng.random(len(spectrum)))
    turned[0] = abs(spectrum[0])
    made = np.fft.irfft(turned, len(x))
    power = np.mean(made**2)
    if power <= np.finfo(float).tiny:
        raise Unusable("there is no energy to make noise of")
    return made * math.sqrt(ratio * np.mean(np.square(x)) / power)


def coherence_of_noise(ratio: float) -> float:
    """What the coherence of two channels is whose noises are `ratio` times as strong as what they share."""
    return (1 + ratio) ** -2


def unrelated(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two signals as the channels of one, cut to the shorter and the second brought to the level of the first."""
    n = min(len(first), len(second))
    left, right = np.array(first[:n], float), np.array(second[:n], float)
    levels = [math.sqrt(np.mean(x**2)) for x in (left, right)]
    if min(levels) <= np.finfo(float).tiny:
        raise Unusable("both signals must sound")
    return left, right * levels[0] / levels[1]


def pan(x: np.ndarray, azimuth: float) -> tuple[np.ndarray, np.ndarray]:
    d = math.tan(math.radians(azimuth)) / math.tan(math.radians(30))
    left, right = (1 + d) / 2, (1 - d) / 2
    power = math.hypot(left, right)
    return np.asarray(x, float) * left / power, np.asarray(x, float) * right / power


def head_shadow(x: np.ndarray, rate: int, azimuth: float, size: int = 1024) -> np.ndarray:
    """Short-time filter with -20 |sin a| f / (f + 1500) dB; zero-padded at both ends, half overlap, length kept."""
    x = np.asarray(x, float)
    size = min(size, len(x)) // 2 * 2
    if azimuth == 0 or size < 2:
        return x.copy()
    hop, w = size // 2, hann(size)
    padded = np.concatenate([np.zeros(size), x, np.zeros(size + (-len(x)) % hop)])
    f = np.fft.rfftfreq(size, 1 / rate)
    gain = 10 ** (-abs(math.sin(math.radians(azimuth))) * f / (f + 1500))
    parts = np.fft.irfft(np.fft.rfft(frames(padded, size, hop) * w, axis=1) * gain, size, axis=1)
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    for i, p in enumerate(parts):
        out[i * hop : i * hop + size] += p * w
        weight[i * hop : i * hop + size] += w * w
    return (out / np.maximum(weight, 1e-12))[size : size + len(x)]


def fractional_delay(x: np.ndarray, delay: float) -> np.ndarray:
    whole, part = int(delay), delay - int(delay)
    moved = (1 - part) * x + part * np.concatenate([[0.0], x[:-1]])
    return np.concatenate([np.zeros(whole), moved])


def binaural(x: np.ndarray, rate: int, azimuth: float) -> tuple[np.ndarray, np.ndarray]:
    """The far ear shadowed and delayed, the near one padded to the same length."""
    if abs(azimuth) > 90:
        raise Unusable("the azimuth must be within 90 degrees")
    x, theta = np.asarray(x, float), math.radians(abs(azimuth))
    far = fractional_delay(head_shadow(x, rate, azimuth), HEAD_M / SOUND_M_S * (theta + math.sin(theta)) * rate)
    near = np.concatenate([x, np.zeros(len(far) - len(x))])
    return (near, far) if azimuth >= 0 else (far, near)


def biquad(x: np.ndarray, b: tuple[float, float, float], a: tuple[float, float]) -> np.ndarray:
    out = np.empty(len(x))
    x1 = x2 = y1 = y2 = 0.0
    for i, v in enumerate(np.asarray(x, float).tolist()):
        y = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
        x2, x1, y2, y1 = x1, v, y1, y
        out[i] = y
    return out


def peaking_eq(x: np.ndarray, rate: int, center_hz: float, gain_db: float, q: float) -> np.ndarray:
    amp, w = 10 ** (gain_db / 40), 2 * math.pi * center_hz / rate
    alpha = math.sin(w) / (2 * q)
    a0 = 1 + alpha / amp
    return biquad(x, ((1 + alpha * amp) / a0, -2 * math.cos(w) / a0, (1 - alpha * amp) / a0), (-2 * math.cos(w) / a0, (1 - alpha / amp) / a0))


def compressor(left: np.ndarray, right: np.ndarray, rate: int, threshold_db: float, ratio: float, attack_s: float = 0.005, release_s: float = 0.1, makeup_db: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """One gain for both channels from the louder one's level, and the makeup gain."""
    if ratio < 1:
        raise ValueError("the ratio must be at least 1")
    level = 20 * np.log10(np.maximum(np.maximum(np.abs(left), np.abs(right)), 1e-12))
    target = np.maximum(level - threshold_db, 0) * (1 - 1 / ratio)
    fast, slow = (math.exp(-1 / (s * rate)) if s > 0 else 0.0 for s in (attack_s, release_s))
    gain, now = np.empty(len(level)), 0.0
    for i, t in enumerate(target.tolist()):
        c = fast if t > now else slow
        now = c * now + (1 - c) * t
        gain[i] = now
    scale = 10 ** ((makeup_db - gain) / 20)
    return np.asarray(left) * scale, np.asarray(right) * scale


#: The damping one-pole as a finite response; what is left out is below the precision of a double.
_DAMP = (1 - DAMPING) * DAMPING ** np.arange(28)


def _comb(x: np.ndarray, delay: int, feedback: float) -> np.ndarray:
    """Feedback comb whose loop is damped by a one-pole; block by block, as a block's loop needs only the block before."""
    out, loop = np.zeros(len(x)), np.zeros(delay)
    last = 0.0
    for start in range(0, len(x), delay):
        n = min(delay, len(x) - start)
        out[start : start + n] = loop[:n]
        damped = np.convolve(loop[:n], _DAMP)[:n]
        k = min(n, 28)
        damped[:k] += last * DAMPING ** np.arange(1, k + 1)
        last = float(damped[-1])
        loop[:n] = x[start : start + n] + feedback * damped
    return out


def _allpass(x: np.ndarray, delay: int, gain: float = ALLPASS_GAIN) -> np.ndarray:
    out, held = np.zeros(len(x)), np.zeros(delay)
    for start in range(0, len(x), delay):
        n = min(delay, len(x) - start)
        part, past = x[start : start + n], held[:n].copy()
        held[:n] = part + gain * past
        out[start : start + n] = past - gain * held[:n]
    return out


def envelope(x: np.ndarray, rate: int) -> np.ndarray:
    """The greater of a sample's size and the envelope before it, which falls to 1/e in 20 ms; in stretches of two seconds."""
    out, last, fall = np.abs(x), 0.0, 0.02 * rate
    rise = np.exp(np.arange(1, min(len(out), 2 * rate) + 1) / fall)
    for start in range(0, len(out), 2 * rate):
        part = out[start : start + 2 * rate]
        part[:] = np.fmax(np.fmax.accumulate(part * rise[: len(part)]), last) / rise[: len(part)]
        last = part[-1]
    return out


@lru_cache(maxsize=4)
def _hiss(seed: int, n: int) -> np.ndarray:
    """Noise of either channel of a reverb."""
    made = np.random.default_rng(seed).normal(size=(2, n)) * 0.6
    made.setflags(write=False)
    return made


def _filtered(source: np.ndarray, rate: int, rt60_s: float, extra: int) -> np.ndarray:
    """The mean of eight combs through four allpasses."""
    late = np.mean([_comb(source, d, 10 ** (-3 * d / (rate * rt60_s))) for d in (max(1, round((d + extra) * rate / 44_100)) for d in COMBS)], axis=0)
    for d in ALLPASSES:
        late = _allpass(late, max(1, round((d + extra) * rate / 44_100)))
    return late


def _smooth(n: int) -> int:
    """The least power of two, or three of one, that is not below n."""
    two = 1 << max(1, n - 1).bit_length()
    return two // 4 * 3 if two // 4 * 3 >= n else two


@lru_cache(maxsize=8)
def _response(taps: int, size: int, rate: int, rt60_s: float, extra: int) -> np.ndarray:
    """Spectrum of what _filtered() makes of a click."""
    click = np.zeros(taps)
    click[0] = 1.0
    return np.fft.rfft(_filtered(click, rate, rt60_s, extra), size)


def reverberation(mono: np.ndarray, rate: int, rt60_s: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """What eight damped combs and four allpasses a channel make of a signal and seeded noise under its envelope, with a tail of 1.2 rt60.

    The filters are linear, so their answer to a click is kept and signals meet it as spectra. It grows with the signal as a whole.
    """
    n, tail = len(mono), round(1.2 * rt60_s * rate)
    taps = _smooth(n + tail)
    size = _smooth(n + taps - 1)
    level, out = envelope(mono, rate), []
    for hiss, extra in zip(_hiss(seed, n), (0, SPREAD)):
        source = mono + hiss * level
        if size > LONGEST_KEPT or not np.isfinite(source).all():
            out.append(_filtered(np.concatenate([source, np.zeros(tail)]), rate, rt60_s, extra))
        else:
            out.append(np.fft.irfft(np.fft.rfft(source, size) * _response(taps, size, rate, rt60_s, extra), size)[: n + tail])
    return out[0], out[1]


def reverb(left: np.ndarray, right: np.ndarray, rate: int, rt60_s: float, wet: float, seed: int = 0, late: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Both channels and the reverberation() of their mono signal, or `late` where that is known already.

    Both grow by a tail of 1.2 rt60, with wet = 0 as well.
    """
    tail = np.zeros(round(1.2 * rt60_s * rate))
    if wet == 0:
        return np.concatenate([left, tail]), np.concatenate([right, tail])
    late = late or reverberation((np.asarray(left, float) + right) / 2, rate, rt60_s, seed)
    left, right = ((1 - wet) * np.concatenate([dry, tail]) + wet * x for dry, x in zip((left, right), late))
    return left, right


def process(left: np.ndarray, right: np.ndarray, rate: int, steps: list[tuple[str, dict]]) -> tuple[np.ndarray, np.ndarray]:
    """A chain of steps by kind, in order."""
    for kind, p in steps:
        if kind == "compression":
            left, right = compressor(left, right, rate, p["threshold_db"], p["ratio"], p.get("attack_s", 0.005), p.get("release_s", 0.1), p.get("makeup_gain_db", 0.0))
        elif kind == "eq":
            left, right = (peaking_eq(x, rate, p["center_hz"], p["gain_db"], p["q"]) for x in (left, right))
        elif kind == "midside":
            mid, side = (left + right) / 2, p["width"] * (left - right) / 2
            left, right = mid + side, mid - side
        elif kind == "delay_widening":
            pad = np.zeros(round(p["delay_us"] * rate / 1e6))
            left, right = np.concatenate([left, pad]), np.concatenate([pad, right])
        elif kind == "reverb":
            left, right = reverb(left, right, rate, p.get("rt60_s", 0.6), p.get("wet", 0.0), int(p.get("seed", 0)))
        else:
            raise ValueError(f"unknown processing kind: {kind}")
    return left, right


def swept(x: np.ndarray, rate: int, angles: tuple[float, ...], chains: dict[str, list[tuple[str, dict]]]) -> Iterator[tuple[str, float, np.ndarray, np.ndarray]]:
    """(chain, angle, left, right): x panned to each angle and sent through each chain.

    The mono signal of a panned one is x times a number, so the reverberation at the head of a chain is x's own times that.
    """
    x, known = np.asarray(x, float), {}
    for chain, steps in chains.items():
        (kind, p), rest = (steps[0], steps[1:]) if steps else (("", {}), [])
        for angle in angles:
            left, right = pan(x, angle)
            if kind == "reverb" and (wet := p.get("wet", 0.0)):
                key = rt60_s, seed = p.get("rt60_s", 0.6), int(p.get("seed", 0))
                if key not in known:
                    known[key] = reverberation(x, rate, rt60_s, seed)
                gain = sum(pan(1.0, angle)) / 2
                left, right = process(*reverb(left, right, rate, rt60_s, wet, seed, tuple(gain * y for y in known[key])), rate, rest)
            else:
                left, right = process(left, right, rate, steps)
            yield chain, angle, left, right


def mixture(left: np.ndarray, right: np.ndarray, rate: int, separation_db: float = 2.65, least: float = 0.05, most: int | None = None) -> list[tuple[float, float]]:
    """(azimuth, energy share) of the sources of a mix, strongest first: peaks of the smoothed density of level differences."""
    _, a, b = active_bins(left, right, rate, per_frame=True)
    ild, energy = np.clip(20 * np.log10(a / b), -60, 60), a**2 + b**2
    grid = np.arange(-60, 60.25, 0.25)
    density = np.bincount(np.rint((ild + 60) / 0.25).astype(int), energy, len(grid))
    kernel = np.exp(-0.5 * (np.arange(-12, 13) * 0.25) ** 2)
    density = np.convolve(density, kernel / kernel.sum(), "same")
    padded = np.concatenate([[-np.inf], density, [-np.inf]])
    peaks = np.flatnonzero((density >= padded[:-2]) & (density > padded[2:]))
    kept: list[int] = []
    for p in peaks[np.argsort(-density[peaks], kind="stable")]:
        if all(abs(grid[p] - grid[q]) >= separation_db for q in kept):
            kept.append(int(p))
    found = []
    for p in kept:
        near = np.abs(ild - grid[p]) <= separation_db / 2
        share = energy[near].sum() / energy.sum()
        if share >= least:
            found.append((float(azimuth_of_ild((ild[near] * energy[near]).sum() / energy[near].sum())), float(share)))
    return sorted(found, key=lambda s: -s[1])[:most]
