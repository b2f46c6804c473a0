"""Quality by an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Grams are four UTF-16 code units long, each in 16 bits. Workers count the grams of the trusted texts they read; the counts are
joined and added by gram over the whole corpus, and the probabilities of each order come from joins of gram counts with
context totals and the next lower order. The highest order has raw counts, lower ones continuation counts, each order its own three
discounts.

A document's perplexity is held against quantiles of the perplexity of trusted texts of its language, each scored by a model that has
not seen it: four more models are trained, each without one of four folds of the trusted texts (by a hash of the id), in the same
joins.
A language's quantiles are taken about its median; the fewer trusted texts it has, the more they lean on those of all languages.

The model is broadcast behind a check of its rows; a larger one is joined with the documents' gram counts instead, with the same
results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, rows_within, stored

ORDER = 4
BITS = 16
#: Stands before the first code unit: a noncharacter that is not for interchange. Where a text holds it, it is read as the one before.
BEGIN = 0xFFFF
#: Quantiles of the trusted texts' perplexity beyond which a document is rejected.
LOW, HIGH = 0.0005, 0.995
#: So many trusted texts of a language weigh as much as those of all languages together.
PRIOR = 50.0
#: Models: of all trusted texts, and of those outside each fold.
ALL, FOLDS = 0, (1, 2, 3, 4)
#: Bytes of text that a worker turns into grams at once; a gram takes eight bytes and a few copies.
BATCH_BYTES = 2 << 20
#: Rows of the model (16 bytes each), and trusted ids, that are broadcast at most.
BROADCAST_ROWS = 4_000_000


def fold_of(doc_id) -> F.Column:
    """Which fold an id is in."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % len(FOLDS) + 1).cast("int")


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code units of the texts one after the other, each with ORDER - 1 marks before it, and where the texts start."""
    mark = np.full(ORDER - 1, BEGIN, np.uint64)
    parts, starts, at = [], [], 0
    for text in texts:
        own = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
        parts += [mark, np.where(own == BEGIN, BEGIN - 1, own).astype(np.uint64)]
        starts.append(at)
        at += len(own) + len(mark)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(starts, np.int64)


def _grams(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The gram that ends at each character of the texts, without the marks."""
    grams = codes.copy()
    for back in range(1, ORDER):
        grams[back:] |= codes[:-back] << np.uint64(BITS * back)
    inner = np.ones(len(codes), bool)
    for i in range(ORDER - 1):
        inner[starts + i] = False
    return grams[inner]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = rows_within(batch, BATCH_BYTES)
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            for fold in FOLDS:
                own = part.filter(pc.equal(part.column("fold"), fold))
                grams, counts = np.unique(_grams(*_codes(own.column("text").to_pylist())), return_counts=True)
                for model in (ALL, *(m for m in FOLDS if m != fold)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), model, np.int32)), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], names=["m", "g", "c"])


def _discounts(counts: DataFrame) -> dict[int, list[float]]:
    """Of each model, for counts of 1, 2 and more."""
    found = {}
    for m, *seen in counts.groupBy("m").agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).collect():
        n = [float(x or 0) for x in seen]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        found[m] = [min(float(i), max(0.1, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] and n[i] else i / 2 for i in (1, 2, 3)]
    return found


def _by_model(values: dict[int, float]) -> F.Column:
    out = F.lit(0.0)
    for m, value in values.items():
        out = F.when(F.col("m") == m, F.lit(float(value))).otherwise(out)
    return out


class Tables:
    """By order, for each model m: probability of each seen gram (m, g, p) and weight of each context (m, g, w); p of an unseen unit."""

    def __init__(self, trusted: DataFrame):
        """trusted: columns `fold` and `text`."""
        counts = {ORDER: stored(trusted.select("fold", "text").mapInArrow(_count, "m int, g long, c long").groupBy("m", "g").agg(F.sum("c").alias("c")), "quality-counts")}
        for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many grams of the order above it is the end
            ending = F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))
            counts[k] = stored(counts[k + 1].groupBy("m", ending.alias("g")).agg(F.count("*").alias("c")), "quality-counts")
        self.seen, self.weight = {}, {}
        for k in range(1, ORDER + 1):
            found = _discounts(counts[k])
            c = F.col("c")
            d = [_by_model({m: values[i] for m, values in found.items()}) for i in range(3)]
            own = counts[k].withColumn("d", F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]))
            if k == 1:  # one context, of which there is one row a model
                totals = own.groupBy("m").agg(F.sum("c").alias("s"), F.sum("d").alias("left"), F.count("*").alias("kinds")).collect()
                rest = {r["m"]: r["left"] / r["s"] / (r["kinds"] + 1) for r in totals}
                self.unseen = {m: rest.get(m, 1.0) for m in (ALL, *FOLDS)}
                seen = own.select("m", "g", ((c - F.col("d")) / _by_model({r["m"]: r["s"] for r in totals}) + _by_model(rest)).alias("p"))
                self.seen[1] = stored(seen, "quality-seen")
                continue
            own = own.withColumn("context", F.shiftrightunsigned("g", BITS)).withColumn("ending", F.col("g").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)))
            totals = stored(own.groupBy("m", "context").agg(F.sum("c").alias("s"), F.sum("d").alias("left")).withColumn("w", F.col("left") / F.col("s")), "quality-contexts")
            lower = self.seen[k - 1].select("m", F.col("g").alias("ending"), F.col("p").alias("below"))
            joined = own.join(totals, ["m", "context"]).join(lower, ["m", "ending"])
            self.seen[k] = stored(joined.select("m", "g", ((c - F.col("d")) / F.col("s") + F.col("w") * F.col("below")).alias("p")), "quality-seen")
            self.weight[k] = totals.select("m", F.col("context").alias("g"), "w")
        self.rows = sum(t.filter(F.col("m") == ALL).count() for t in [*self.seen.values(), *self.weight.values()])  # no fold's has more

    def arrays(self, model: int = ALL) -> dict:
        """What a Lookup needs; only for models of a checked size."""
        out = {"unseen": self.unseen[model]}
        for name, tables, value in (("seen", self.seen, "p"), ("weight", self.weight, "w")):
            for k, t in tables.items():
                found = t.filter(F.col("m") == model).select("g", value).toArrow()
                out[name, k] = (found.column("g").to_numpy().view(np.uint64), found.column(value).to_numpy())
        return out


class _Index:
    """Values by 64-bit key. Keys are spread by an odd multiplier, which loses nothing, and sorted; a table has each bucket's start."""

    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = keys * self.SPREAD
        order = np.argsort(hashed)
        self.hashed, self.values = hashed[order], values[order]
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        buckets = (self.hashed >> self.shift).astype(np.int64)
        self.starts = np.searchsorted(buckets, np.arange((1 << int(64 - self.shift)) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.starts).max()) if len(keys) else 0

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where there is none."""
        out = np.full(len(keys), np.nan)
        if not len(self.values):
            return out
        hashed = keys * self.SPREAD
        at = self.starts[(hashed >> self.shift).astype(np.int64)]
        last = len(self.hashed) - 1
        todo = None
        for i in range(self.longest):
            place = np.minimum((at if todo is None else at[todo]) + i, last)
            same = self.hashed[place] == (hashed if todo is None else hashed[todo])
            if todo is None:
                out[same] = self.values[place[same]]
                todo = np.flatnonzero(~same)
            else:
                out[todo[same]] = self.values[place[same]]
                todo = todo[~same]
            if not len(todo):
                break
        return out


class Lookup:
    def __init__(self, arrays: dict):
        self.unseen = arrays["unseen"]
        self.seen = {k: _Index(*arrays["seen", k]) for k in range(1, ORDER + 1)}
        self.weight = {k: _Index(*arrays["weight", k]) for k in range(2, ORDER + 1)}

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        return np.log(self._p(grams, ORDER))

    def _p(self, grams: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full(len(grams), self.unseen)
        p = self.seen[k](grams)
        if len(new := np.flatnonzero(np.isnan(p))):
            keys = grams[new]
            lower = self._p(keys & np.uint64((1 << BITS * (k - 1)) - 1), k - 1)
            w = self.weight[k](keys >> np.uint64(BITS)) if k > 1 else np.ones(len(keys))  # `unseen` has the weight of no context
            p[new] = np.where(np.isnan(w), 1.0, w) * lower
        return p

    def perplexities(self, texts: list[str | None], step: int = 1 << 20) -> np.ndarray:
        """Of each text; NaN for one without characters."""
        codes, starts = _codes(texts)
        grams = _grams(codes, starts)
        sizes = np.diff(np.append(starts, len(codes))) - (ORDER - 1)
        logs = np.concatenate([self.log_p(grams[i : i + step]) for i in range(0, len(grams), step)]) if len(grams) else np.zeros(0)
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        ends = np.cumsum(sizes)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.exp(-(sums[ends] - sums[ends - sizes]) / sizes)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled as good and never as bad or toxic."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("quality"), F.col("toxic").alias("toxic")).filter("doc_id IS NOT NULL")
    return marks.groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))).alias("trusted")).filter("trusted").select("doc_id")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with these ids; few ids are broadcast, so that texts stay where they are."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")


def _plain(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))


def _scored(rows: DataFrame, tables: Tables, broadcast_rows: int, model: int = ALL) -> DataFrame:
    """(doc_id, lang, perplexity) of (doc_id, text, lang)."""
    if tables.rows <= broadcast_rows:
        held = rows.sparkSession.sparkContext.broadcast(tables.arrays(model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup = Lookup(held.value)
            for batch in batches:
                step = rows_within(batch, BATCH_BYTES)
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    found = lookup.perplexities(part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(found, pa.float64(), mask=np.isnan(found))], names=["doc_id", "lang", "perplexity"])

        return rows.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, perplexity double")
    return _joined(rows, tables, model)


def _joined(rows: DataFrame, tables: Tables, model: int = ALL) -> DataFrame:
    """The same by joins of the documents' gram counts with the tables, for models that are too large to broadcast."""
    numbered = stored(rows.select("doc_id", "text", "lang").withColumn("row", F.monotonically_increasing_id()), "quality-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                grams, counts = np.unique(_grams(*_codes([text])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), row)), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], names=["row", "g", "n"])

    counts = numbered.select("row", "text").mapInArrow(run, "row long, g long, n long")
    p = F.lit(tables.unseen[model])
    for k in range(1, ORDER + 1):
        own = F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1)) if k < ORDER else F.col("g")
        seen = tables.seen[k].filter(F.col("m") == model).select(F.col("g").alias("key"), F.col("p").alias(f"p{k}"))
        counts = counts.withColumn("key", own).join(seen, "key", "left").drop("key")
        if k > 1:
            weight = tables.weight[k].filter(F.col("m") == model).select(F.col("g").alias("key"), F.col("w").alias(f"w{k}"))
            counts = counts.withColumn("key", F.shiftrightunsigned(own, BITS)).join(weight, "key", "left").drop("key")
        p = F.coalesce(f"p{k}", F.coalesce(f"w{k}", F.lit(1.0)) * p if k > 1 else p)
    sums = counts.withColumn("log_p", F.log(p)).groupBy("row").agg(F.exp(-F.sum(F.col("n") * F.col("log_p")) / F.sum("n")).alias("perplexity"))
    return numbered.select("row", "doc_id", "lang").join(sums, "row", "left").select("doc_id", "lang", "perplexity")


def bounds_of(trusted: DataFrame, low: float = LOW, high: float = HIGH, prior: float = PRIOR) -> DataFrame:
    """(lang, low, high) of the languages of trusted texts, (lang, perplexity, unseen): scored by the model of all and, where `unseen`,
    by a model that has not seen them. The upper bounds come from the latter alone, the lower ones from both.

    In logarithms, about the language's median: the quantiles of its n texts weigh n, those of all languages `prior`.
    """
    plain = trusted.filter("perplexity IS NOT NULL").select("lang", F.log("perplexity").alias("x"), "unseen")
    new = F.when(F.col("unseen"), F.col("x"))
    medians = stored(plain.groupBy("lang").agg(F.percentile_approx(new, F.lit(0.5), 10_000).alias("median"), F.count(new).alias("n")), "quality-medians")
    about = plain.join(F.broadcast(medians) if medians.count() <= 10_000 else medians, "lang").select("lang", "unseen", (F.col("x") - F.col("median")).alias("z"))
    ends = [F.percentile_approx("z", F.lit(low), 10_000).alias("below"), F.percentile_approx(F.when(F.col("unseen"), F.col("z")), F.lit(high), 10_000).alias("above")]
    every = about.agg(*ends).first()
    own = about.groupBy("lang").agg(*ends).join(medians, "lang")
    n = F.col("n")
    pick = [F.exp(F.col("median") + (n * F.col(c) + F.lit(prior * (every[c] or 0.0))) / (n + prior)) for c in ("below", "above")]
    return own.select("lang", pick[0].alias("low"), pick[1].alias("high"))


def _bounds(trusted: DataFrame, tables: Tables, low: float, high: float, broadcast_rows: int) -> DataFrame:
    """bounds_of() trusted (doc_id, text, lang, fold)."""
    scored = _scored(trusted, tables, broadcast_rows).withColumn("unseen", F.lit(False))
    for fold in FOLDS:
        scored = scored.unionByName(_scored(trusted.filter(F.col("fold") == fold), tables, broadcast_rows, fold).withColumn("unseen", F.lit(True)))
    return stored(bounds_of(stored(scored, "quality-scores"), low, high), "quality-bounds")


def _judged(perplexity, low, high) -> F.Column:
    """Languages without a trusted text have no bounds and take what has a perplexity."""
    return F.coalesce(perplexity.between(F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(math.inf))), F.lit(False))


def _fitted(rows: DataFrame, labels: DataFrame, low: float, high: float, broadcast_rows: int) -> tuple[Tables, DataFrame]:
    ids = stored(trusted_ids(labels), "quality-ids")
    trusted = stored(_of(rows, ids).withColumn("fold", fold_of(F.col("doc_id"))), "quality-trusted")
    tables = Tables(trusted)
    bounds = _bounds(trusted, tables, low, high, broadcast_rows)
    discard(trusted)
    return tables, bounds


def judge(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, lang, perplexity, low, high, accepted): one row for each row of docs.

    Texts that are null or empty have no perplexity and are not accepted. A null language is `und`. A language without trusted text
    has no bounds, and every text of it with a character is accepted. Repeated rows give repeated rows; an empty table gives none.
    labels: (doc_id, quality, toxic); of repeated labels all must be good. Other columns play no part.
    """
    rows = _plain(docs, id_col, text_col, lang_col)
    tables, bounds = _fitted(rows, labels, low, high, broadcast_rows)
    scores = _scored(rows, tables, broadcast_rows)
    # a language may hold most rows; the bounds of as many languages as there can be are broadcast
    return scores.join(F.broadcast(bounds) if bounds.count() <= 10_000 else bounds, "lang", "left").select("doc_id", "lang", "perplexity", "low", "high", _judged(F.col("perplexity"), F.col("low"), F.col("high")).alias("accepted"))


def keep_good(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that judge() accepts, with all their columns, whatever their names; null, empty and repeated rows as there.

    With a broadcast model the texts are scored where they are kept; else the accepted rows come by a join.
    """
    rows = _plain(docs, id_col, text_col, lang_col)
    tables, bounds = _fitted(rows, labels, low, high, broadcast_rows)
    if tables.rows <= broadcast_rows and (n := bounds.count()) <= 10_000:
        held = docs.sparkSession.sparkContext.broadcast((tables.arrays(), {r["lang"]: (r["low"], r["high"]) for r in bounds.limit(n).collect()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays, ends = held.value
            lookup = Lookup(arrays)
            for batch in batches:
                step = rows_within(batch, BATCH_BYTES)
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    found = lookup.perplexities(part.column(text_col).cast(pa.string()).to_pylist())
                    limits = [ends.get("und" if x is None else x, (0.0, math.inf)) for x in part.column(lang_col).cast(pa.string()).to_pylist()]
                    yield part.filter(pa.array([bool(a <= p <= b) for p, (a, b) in zip(found.tolist(), limits)], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    # a row's verdict depends on its language and text alone, so equal rows of an id share it
    text, lang = fresh(docs, "text_hash"), fresh(docs, "language")
    sized = docs.withColumn(text, F.xxhash64(F.col(text_col).cast("string"))).withColumn(lang, F.coalesce(F.col(lang_col).cast("string"), F.lit("und")))
    keyed = rows.withColumn("key", F.xxhash64("text"))
    verdicts = _scored(keyed.groupBy("key", "lang").agg(F.first("text").alias("text")).select(F.col("key").alias("doc_id"), "text", "lang"), tables, broadcast_rows).join(bounds, "lang", "left").filter(_judged(F.col("perplexity"), F.col("low"), F.col("high")))
    good = verdicts.select(F.col("doc_id").alias(text), F.col("lang").alias(lang)).distinct()
    return sized.join(good, [text, lang], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
