"""Personal data: base patterns, random identifiers, and information-theoretic sanitisation of the terms that reveal them.

Protected entities are the values that the four base patterns find, and secrets: runs of word characters that carry at least
``SECRET_BITS`` bits (length times the entropy of their own characters) and change between letters and digits as a random string
does. Over the whole corpus, the terms near an entity are counted with it, and documents with the term (n_t), with the entity
(n_e) and with both (n_te) of all N. Of the self-information -log2(n_e / N), a term discloses the share
log2(n_te N / (n_t n_e)) / -log2(n_e / N), which is 1 when the term stands only beside that entity. The same is estimated for each
class of entities (kind k: n_k, n_tk), as most values stand once in a corpus while words such as ``token`` lead to many of them.

A term that discloses at least ``GENERALISE`` of one entity, in at least ``SUPPORT`` different texts, or of a class, beside at least
``VALUES`` different values of it (so that copies of one passage count once), is replaced by a general mark wherever it occurs;
from ``REMOVE`` on it is removed. What is assigned to a term that discloses the class of secrets (``term = value``) is a secret too,
whatever it looks like.

A term is a run of at least ``LETTERS`` bytes of a-z (A-Z folded) or of characters beyond ASCII.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_within, stored

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE, SECRET, TERM = 4, 4, 5
GENERALISE = 0.9
REMOVE = 0.98
SUPPORT = 3
VALUES = 5
LETTERS = 4
#: Least length and bits of a secret, and how often it changes between letters and digits: once in so many characters.
SECRET_LENGTH, SECRET_BITS, SECRET_TURN = 16, 56.0, 6
#: Terms on each side of an entity that count as near it.
NEAR = 6
#: Flagged terms that one pass over the documents looks up; more terms take more passes.
BLOCK_TERMS = 200_000
#: Distinct terms that a worker counts before it passes the counts on.
HELD_TERMS = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
_RUN = re.compile(r"[A-Za-z0-9_-]{%d,}" % SECRET_LENGTH)
_TURN = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
_ASSIGNED = re.compile(r"[\"']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*[\"']?([^\s\"'<>,;]{8,})")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @: the run of local characters before it, as far as the match before, and a domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; code points, end exclusive."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            if len(m[0]) <= 40 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def is_secret(run: str) -> bool:
    """Whether a run of word characters looks drawn at random."""
    if len(_TURN.findall(run)) * SECRET_TURN < len(run):
        return False
    n = len(run)
    return -sum(c * math.log2(c / n) for c in Counter(run).values()) >= SECRET_BITS


def entity_spans(text: str) -> list[tuple[int, int, int]]:
    """base_spans() and the secrets beside them, in the same form and order."""
    found = base_spans(text)
    if _DIGIT.search(text):
        taken = _Taken([(a, b) for a, _, b in found])
        found += [(m.start(), SECRET, m.end()) for m in _RUN.finditer(text) if is_secret(m[0]) and not taken(m.start(), m.end())]
    return sorted(found)


def _terms(text: str) -> list[bytes]:
    return [t for t in text.encode().translate(_FOLD).split() if len(t) >= LETTERS]


def _entity(text: str, span: tuple[int, int, int]) -> int:
    value = text[span[0] : span[2]].lower()
    if 0 < span[1] < BASE:
        value = "".join(c for c in value if c.isdigit() or c == ".")
    return xxhash.xxh64_intdigest(f"{KINDS[span[1]]}:{value}".encode()) - (1 << 63)


class _Taken:
    """Whether a stretch overlaps one of the given ones, which are in order of their starts."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def _near(text: str, span: tuple[int, int, int], taken: _Taken) -> set[bytes]:
    """Terms beside an entity that are part of no entity. What is read on each side is widened until it holds NEAR terms."""
    found = set()
    for ahead in (False, True):
        width = 128
        while True:
            a, b = (span[2], min(len(text), span[2] + width)) if ahead else (max(0, span[0] - width), span[0])
            runs = [(m.start() + a, m.end() + a, m[0]) for m in _TERM.finditer(text[a:b])]
            whole = b == len(text) if ahead else a == 0
            if not whole and runs:  # the outermost may be cut
                runs = runs[:-1] if ahead else runs[1:]
            terms = [(x, y, t) for x, y, r in runs if len(t := r.encode().translate(_FOLD)) >= LETTERS and not taken(x, y)]
            if whole or len(terms) >= NEAR:
                found.update(t for _, _, t in (terms[:NEAR] if ahead else terms[-NEAR:]))
                break
            width *= 4
    return found


_COUNTS = pa.schema([("term", pa.string()), ("kind", pa.int32()), ("entity", pa.int64()), ("source", pa.int64()), ("n", pa.int64()), ("first", pa.int64())])
_COUNTS_SQL = "term string, kind int, entity long, source long, n long, first long"


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_COUNTS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)


def _beside(text: str) -> dict[tuple[int, int], set[bytes]]:
    """By kind and entity of the text: the terms near it."""
    spans = entity_spans(text)
    taken = _Taken([(a, b) for a, _, b in spans])
    found: dict[tuple[int, int], set[bytes]] = {}
    for span in spans:
        found.setdefault((span[1], _entity(text, span)), set()).update(_near(text, span, taken))
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of four kinds: documents with a term (entity null), with an entity (term null), with both, and all (both null).

    `first` is 1 for one of the entities of a kind in a document, or beside a term in it, so that its sum counts documents.
    """
    held: Counter[bytes] = Counter()
    for batch in batches:
        step = rows_within(batch)
        for start in range(0, batch.num_rows, step):
            rows: list[tuple] = [(None, None, None, None, min(step, batch.num_rows - start), 0)]
            for text in batch.column("text").slice(start, step).to_pylist():
                if not text:
                    continue
                held.update(set(_terms(text)))
                if not (beside := _beside(text)):
                    continue
                source = xxhash.xxh64_intdigest(text.encode()) - (1 << 63)
                met: set = set()
                for (kind, entity), terms in beside.items():
                    for term in (None, *sorted(terms)):
                        rows.append((term and term.decode(), kind, entity, source, 1, int((term, kind) not in met)))
                        met.add((term, kind))
            yield _counts(rows)
            if len(held) > HELD_TERMS:
                yield _counts([(t.decode(), None, None, None, n, 0) for t, n in held.items()])
                held.clear()
    yield _counts([(t.decode(), None, None, None, n, 0) for t, n in held.items()])


def _share(both: str, one: str, other: str, total: int) -> F.Column:
    return F.log2(F.col(both) * F.lit(float(total)) / (F.col(one) * F.col(other))) / -F.log2(F.col(other) / F.lit(float(max(total, 1))))


def disclosing_terms(docs: DataFrame, text_col: str = "text", generalise: float = GENERALISE, support: int = SUPPORT, values: int = VALUES) -> DataFrame:
    """(term, disclosure, leads): the terms that disclose at least `generalise` of some entity or class, with the largest share;
    leads: whether they disclose the class of secrets."""
    counts = stored(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, _COUNTS_SQL), "pii-counts")
    pairs = counts.filter("term IS NOT NULL AND entity IS NOT NULL").groupBy("term", "kind", "entity", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    both = stored(pairs.groupBy("term", "kind", "entity").agg(F.sum("n").alias("n_te"), F.sum("first").alias("n_first"), F.count("*").alias("texts")), "pii-pairs")
    known = counts.filter("term IS NULL AND entity IS NOT NULL")
    entities = known.groupBy("kind", "entity").agg(F.sum("n").alias("n_e"))
    classes = known.groupBy("kind").agg(F.sum("first").alias("n_k"))  # a row for each kind
    total = counts.filter("term IS NULL AND entity IS NULL").agg(F.sum("n")).first()[0] or 0
    single = both.filter(F.col("texts") >= support).join(entities, ["kind", "entity"]).filter(F.col("n_e") < total)
    many = both.groupBy("term", "kind").agg(F.sum("n_first").alias("n_tk"), F.count("*").alias("values")).filter(F.col("values") >= values).join(F.broadcast(classes), "kind").filter(F.col("n_k") < total)
    asked = single.select("term", F.col("n_te").alias("n_both"), F.col("n_e").alias("n_one"), F.lit(False).alias("leads")).unionByName(many.select("term", F.col("n_tk").alias("n_both"), F.col("n_k").alias("n_one"), (F.col("kind") == SECRET).alias("leads")))
    asked = stored(asked, "pii-asked")
    terms = counts.filter("term IS NOT NULL AND entity IS NULL").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_t"))
    scored = asked.join(terms, "term").withColumn("disclosure", _share("n_both", "n_t", "n_one", total))
    return scored.filter(F.col("disclosure") >= generalise).groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.max("leads").alias("leads"))


def _blocks(flagged: DataFrame, size: int) -> Iterator[dict[bytes, tuple[float, bool]]]:
    block: dict[bytes, tuple[float, bool]] = {}
    for term, share, leads in flagged.orderBy("term").toLocalIterator():
        block[term.encode()] = (share, leads)
        if len(block) == size:
            yield block
            block = {}
    yield block


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("disclosure", pa.float64())]))
_SPAN_SQL = "array<struct<start: long, kind: int, end: long, disclosure: double>>"


def _found(text: str | None, flagged: dict[bytes, tuple[float, bool]], before: list[dict] | None) -> list[dict]:
    text = text or ""
    spans = [{"start": a, "kind": k, "end": b, "disclosure": None} for a, k, b in entity_spans(text)] if before is None else before
    if flagged and not flagged.keys().isdisjoint(_terms(text)):
        taken = _Taken([(s["start"], s["end"]) for s in spans if s["kind"] < TERM])
        for m in _TERM.finditer(text):
            hit = flagged.get(m[0].encode().translate(_FOLD))
            if hit is not None and not taken(m.start(), m.end()):
                spans.append({"start": m.start(), "kind": TERM, "end": m.end(), "disclosure": hit[0]})
                if hit[1] and (value := _ASSIGNED.match(text, m.end())) and not taken(*value.span(1)):
                    spans.append({"start": value.start(1), "kind": SECRET, "end": value.end(1), "disclosure": None})
        spans.sort(key=lambda s: (s["start"], s["kind"], s["end"]))
    return spans


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, support: int = SUPPORT, values: int = VALUES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(doc_id, text, spans): one row for each row of docs with the spans of personal data in the whole text.

    Nulls and empty texts have no spans; repeated rows give repeated rows and count as often; an empty table gives none. Where every
    document has a class, nothing discloses it. Other columns play no part.
    """
    spark = docs.sparkSession
    now = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for i, block in enumerate(_blocks(disclosing_terms(now, "text", generalise, support, values), block_terms)):
        held = spark.sparkContext.broadcast(block)
        if i:
            now = stored(now, "pii-block")

        def run(batches: Iterator[pa.RecordBatch], held=held, first=i == 0) -> Iterator[pa.RecordBatch]:
            flagged = held.value
            for batch in batches:
                step = rows_within(batch)
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    before = [None] * part.num_rows if first else part.column("spans").to_pylist()
                    spans = pa.array([_found(t, flagged, b) for t, b in zip(part.column("text").to_pylist(), before)], _SPAN)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), spans], names=["doc_id", "text", "spans"])

        now = now.mapInArrow(run, f"doc_id long, text string, spans {_SPAN_SQL}")
    return now


def sanitised(found: DataFrame, remove: float = REMOVE) -> DataFrame:
    """(doc_id, text): the texts of personal_data() with entities as [KIND], terms as [TERM] or, from `remove` on, left out.

    Null texts stay null, and texts without spans as they are. Spans that overlap are one stretch.
    """

    def clean(text: str | None, spans: list[dict]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for s in spans:
            if s["start"] < at:  # overlaps one before; what it has beyond that goes too
                at = max(at, s["end"])
                continue
            out.append(text[at : s["start"]])
            if s["kind"] < TERM or s["disclosure"] < remove:
                out.append(f"[{KINDS[s['kind']].upper()}]")
            at = s["end"]
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(t, s or []) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return found.mapInArrow(run, "doc_id long, text string")


def digest(found: DataFrame) -> DataFrame:
    """The fixed result columns of a personal_data() table."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return found.select("doc_id", *map(count, range(BASE)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count(SECRET), count(TERM), F.size("spans").cast("long").alias("n_spans"))
