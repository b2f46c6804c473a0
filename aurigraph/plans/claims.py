"""SQL of the claims in a text and of the checks of a transcript, for the counterparts of queries."""

from __future__ import annotations

#: SQL of a text's signed final azimuth, and of what it is built on, for the counterparts.
CLAIMS = r"""adj AS (SELECT *, regexp_extract_all(answer, '(?i)[0-9]+(?:\.[0-9]+)?\s*(?:degrees?|°)\s*(?:to the\s+)?(?:left|right)') AS am,
  string_split_regex(answer, '(?i)[0-9]+(?:\.[0-9]+)?\s*(?:degrees?|°)\s*(?:to the\s+)?(?:left|right)') AS ap,
  regexp_extract_all(answer, '(?i)[0-9]+(?:\.[0-9]+)?[\s-]*(?:degrees?|°)') AS bm,
  string_split_regex(answer, '(?i)[0-9]+(?:\.[0-9]+)?[\s-]*(?:degrees?|°)') AS bp FROM texts),
spanned AS (SELECT *, list_transform(range(1, len(am) + 1), lambda i: struct_pack(s := CAST(coalesce(list_sum(list_transform(ap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(am[1:i-1], lambda x: length(x))), 0) AS INT), m := am[i])) AS a,
  list_transform(range(1, len(bm) + 1), lambda i: struct_pack(s := CAST(coalesce(list_sum(list_transform(bp[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(bm[1:i-1], lambda x: length(x))), 0) AS INT), m := bm[i])) AS b FROM adj),
exploded AS (SELECT item_id, answer, a, unnest(a) AS x, true AS near FROM spanned UNION ALL SELECT item_id, answer, a, unnest(b) AS x, false AS near FROM spanned),
sided AS (SELECT item_id, x.s AS s, x.s + length(x.m) AS e, CAST(regexp_extract(x.m, '[0-9]+(?:\.[0-9]+)?') AS DOUBLE) AS magnitude,
  lower(CASE WHEN near THEN regexp_extract(x.m, '(?i)(left|right)$', 1) ELSE regexp_extract(substr(answer, greatest(x.s - 60, 0) + 1, x.s + length(x.m) + 60 - greatest(x.s - 60, 0)), '(?i)\b(left|right)\b', 1) END) AS side, near,
  len(list_filter(a, lambda y: y.s < x.s + length(x.m) AND x.s < y.s + length(y.m))) AS over FROM exploded),
claims AS (SELECT item_id, s, e, magnitude, side FROM sided WHERE near OR (over = 0 AND side <> '')),
finals AS (SELECT t.item_id, coalesce(arg_max(CASE WHEN c.side = 'left' THEN c.magnitude ELSE 0.0 - c.magnitude END, c.s), CASE WHEN regexp_matches(any_value(t.answer), '(?i)\bcent(?:er|re|red)\b') THEN 0.0 END) AS predicted
  FROM texts t LEFT JOIN claims c ON t.item_id = c.item_id GROUP BY t.item_id)"""


def _first_span(pattern: str, of: str = "transcript") -> str:
    """SQL of the 0-based start of a pattern's first match."""
    return f"length(string_split_regex({of}, '{pattern}')[1])"


_N = r"[0-9]+(?:\.[0-9]+)?"
#: SQL of each claim of a transcript; a window reaches 60 characters to both sides of the whole match.
_WIN = "substr(transcript, greatest({s} - 60, 0) + 1, {s} + length({m}) + 60 - greatest({s} - 60, 0))"


def _claim(name: str, pattern: str) -> str:
    return f"regexp_extract(transcript, '{pattern}') AS {name}_m, {_first_span(pattern)} AS {name}_s"


CLAIMED = f"""WITH raw AS (SELECT t.item_id, t.transcript, e.estimated_azimuth_deg, e.ild_db, e.itd_us, e.coherence, e.f0_hz, e.estimated_regime,
  {_claim("ild", rf"(?i){_N}\s*dB\b")}, {_claim("us", rf"(?i){_N}\s*microseconds?\b")}, {_claim("nodelay", r"(?i)\bno\s+(?:inter-?channel\s+)?delay\b")},
  regexp_extract(transcript, '(?i)coherence\\D{{0,20}}?({_N})', 1) AS coh, regexp_extract(transcript, '({_N})\\s*Hz\\b', 1) AS hz,
  regexp_extract(transcript, '(?i)r\\s*=\\s*10\\^\\(\\s*(-?{_N})\\s*/\\s*20\\s*\\)\\s*=\\s*({_N})', 1) AS px, regexp_extract(transcript, '(?i)r\\s*=\\s*10\\^\\(\\s*(-?{_N})\\s*/\\s*20\\s*\\)\\s*=\\s*({_N})', 2) AS py,
  regexp_extract(transcript, '({_N}) degrees to the (left|right)\\.$', 1) AS deg, regexp_extract(transcript, '({_N}) degrees to the (left|right)\\.$', 2) AS side
  FROM {{transcripts}} t JOIN {{evidence}} e ON t.item_id = e.item_id),
sided AS (SELECT *, lower(regexp_extract({_WIN.format(s="ild_s", m="ild_m")}, '(?i)\\b(left|right)\\b', 1)) AS ild_side, {_WIN.format(s="ild_s", m="ild_m")} LIKE '%louder%' AS ild_loud,
  lower(regexp_extract({_WIN.format(s="us_s", m="us_m")}, '(?i)\\b(left|right)\\b\\s+channel\\s+later', 1)) AS later FROM raw),
claims AS (SELECT item_id, transcript, estimated_azimuth_deg, ild_db AS measured_ild, itd_us AS measured_itd, coherence AS measured_coherence, f0_hz AS measured_f0, estimated_regime,
  CAST(deg AS DOUBLE) AS magnitude, side,
  CASE WHEN ild_m <> '' AND ild_side <> '' AND ild_loud THEN CAST(regexp_extract(ild_m, '{_N}') AS DOUBLE) * CASE WHEN ild_side = 'left' THEN 1 ELSE -1 END END AS ild,
  CASE WHEN nodelay_m <> '' THEN 0.0 WHEN us_m <> '' THEN CAST(regexp_extract(us_m, '{_N}') AS DOUBLE) * CASE WHEN later = 'left' THEN -1 ELSE 1 END END AS itd,
  CASE WHEN coh <> '' THEN CAST(coh AS DOUBLE) WHEN regexp_matches(transcript, '(?i)\\b(no coherence|not coherent|decorrelated|uncorrelated)\\b') THEN 0.0 WHEN regexp_matches(transcript, '(?i)\\b(highly|perfectly|fully) coherent\\b') THEN 1.0 END AS coherence,
  CASE WHEN regexp_matches(transcript, '(?i)\\bbinaural\\b|genuinely delayed|time-delay|time delay|delayed regime') THEN 'delayed' WHEN regexp_matches(transcript, '(?i)amplitude[-\\s]panned|amplitude panning|amplitude regime') THEN 'amplitude' END AS regime,
  CASE WHEN hz <> '' THEN CAST(hz AS DOUBLE) END AS f0, CASE WHEN px <> '' THEN CAST(px AS DOUBLE) END AS px, CASE WHEN px <> '' THEN CAST(py AS DOUBLE) END AS py FROM sided)
"""

CHECKS = CLAIMED + """, checks AS (
  SELECT item_id, 'estimated_azimuth_deg_side' AS quantity, estimated_azimuth_deg = 0 OR side = CASE WHEN estimated_azimuth_deg > 0 THEN 'left' ELSE 'right' END AS passed, 'inference' AS kind FROM claims
  UNION ALL SELECT item_id, 'estimated_azimuth_deg_magnitude', abs(magnitude - abs(estimated_azimuth_deg)) <= 5.0, 'inference' FROM claims
  UNION ALL SELECT item_id, 'ild_db', abs(ild - measured_ild) <= 1.5, 'read_out' FROM claims WHERE ild IS NOT NULL
  UNION ALL SELECT item_id, 'itd_us', abs(itd - measured_itd) <= 30.0, 'read_out' FROM claims WHERE itd IS NOT NULL
  UNION ALL SELECT item_id, 'coherence', abs(coherence - measured_coherence) <= 0.1, 'read_out' FROM claims WHERE coherence IS NOT NULL
  UNION ALL SELECT item_id, 'estimated_regime', regime = estimated_regime, 'inference' FROM claims WHERE regime IS NOT NULL
  UNION ALL SELECT item_id, 'f0_hz', abs(f0 - measured_f0) <= 0.03 * measured_f0, 'read_out' FROM claims WHERE f0 IS NOT NULL AND measured_f0 IS NOT NULL
  UNION ALL SELECT item_id, 'premise_r_matches_its_own_stated_cue', py > 0 AND abs(20 * log10(CASE WHEN py > 0 THEN py ELSE 1 END) - px) <= 0.5, 'inference' FROM claims WHERE px IS NOT NULL)
"""
