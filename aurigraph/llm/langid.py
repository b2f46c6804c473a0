"""Language by compression: the language whose zstandard raw-content dictionary packs a text smallest.

Each dictionary is ordinary text of one language. A text is packed in pieces, each on its own, so that what helps is the
dictionary and not the text before; every piece of the whole text counts. Where the best two sizes are close, the
language is named but not accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_within, small_batches, stored

#: The bounded sample that the dictionaries are fitted on: at most so many labelled texts a language, each read as far as SAMPLE_BYTES,
#: as many of them as fit into the language's dictionary.
SAMPLE_TEXTS = 96
SAMPLE_BYTES = 16_384
#: Bytes of one dictionary, and of all together however many languages there are.
DICTIONARY_BYTES = 65_536
ALL_BYTES = 32 << 20
PIECE_BYTES = 2048
LEVEL = 11
#: The best size must be smaller than the second by this share to be accepted.
MARGIN = 0.02

_WORD = re.compile(r"[^\W\d_]+")
_FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: str) -> bytes:
    """Lower-case words without digits and ASCII punctuation, so that loud or noisy prose packs as its language does."""
    return b" ".join(text.lower().encode().translate(_FOLD).split())


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode's category L; fractions and Roman numeral signs are not."""
    return any(c.isalpha() for m in _WORD.finditer(text) for c in m[0])


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language from a bounded sample: different texts in order of their hashes, those within SAMPLE_BYTES
    first. At most ALL_BYTES come to the driver."""
    plain = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    size = F.octet_length("text")
    keyed = plain.withColumn("long", size > SAMPLE_BYTES).withColumn("h", F.xxhash64("text"))
    order = ("long", "h")
    parts = keyed.select("lang", *order, F.least(size, F.lit(SAMPLE_BYTES)).alias("bytes")).distinct().withColumn("part", F.pmod("h", F.lit(64)))  # a language may hold most texts
    first = parts.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("n") <= SAMPLE_TEXTS)
    by_lang = Window.partitionBy("lang").orderBy(*order)
    ranked = stored(first.withColumn("n", F.row_number().over(by_lang)).filter(F.col("n") <= SAMPLE_TEXTS).select("lang", *order, "bytes"), "langid-sample")
    langs = ranked.select("lang").distinct().count()
    each = min(DICTIONARY_BYTES, ALL_BYTES // max(1, langs))
    # whole texts as far as they fit; the first of a language always
    upto = F.sum("bytes").over(by_lang.rowsBetween(Window.unboundedPreceding, 0))
    chosen = stored(ranked.withColumn("upto", upto).filter((F.col("upto") <= each) | (F.col("upto") == F.col("bytes"))).select("lang", *order), "langid-chosen")
    some = F.broadcast(chosen) if chosen.count() <= 100_000 else chosen  # they go to the texts, not the texts to them
    rows = keyed.join(some, ["lang", *order], "left_semi").groupBy("lang", "h").agg(F.min(F.substring(F.col("text").cast("binary"), 1, min(SAMPLE_BYTES, each))).alias("data"))
    texts: dict[str, list[bytes]] = {}
    for lang, _, data in rows.orderBy("lang", "h").toLocalIterator():
        texts.setdefault(lang, []).append(folded(bytes(data).decode(errors="ignore")))
    return {lang: b"\n".join(own) for lang, own in sorted(texts.items())}


def _compressors(dictionaries: dict[str, bytes], langs: list[str]) -> list[zstandard.ZstdCompressor]:
    out = []
    for lang in langs:
        content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False))
    return out


class Packer:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.compressors = _compressors(dictionaries, self.langs)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, share by which the best is smaller than the second, accepted)."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, False
        data = folded(text)
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)] or [b""]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for c, lang in zip(self.compressors, self.langs))
        if len(sizes) == 1:
            return sizes[0][1], 1.0, True
        score = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], score, score >= MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted): one row for each row of docs.

    Null texts, texts without a letter and anything where no language was learned are `und` with score 0. Ties go to the
    language that is first by name, with score 0. Repeated rows give repeated rows; a null id counts as an empty one for held_out.
    """
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # ALL_BYTES at most
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer(held.value)
        for batch in batches:
            step = rows_within(batch)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                langs, scores, accepted = zip(*map(pack, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """predict() with what fit() learns from the documents that are not held out."""
    return predict(docs, fit(docs.filter(~held_out(id_col)), text_col, lang_col), id_col, text_col)
