"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. The automaton accepts every run of words
inside an item. A document's words stream through it; the length of the longest match that ends at each word is tracked, and
a match of ``WINDOW`` words (or a whole shorter item) marks its words as hit. Which items hold a window is kept with the state that
stands for it. Items are read in blocks of bounded size, each with an automaton of its own, so that no worker holds more than one.

With more than one block, one pass over the documents first holds the hashes of their windows against those of the items' windows
(8 bytes each, broadcast in bounded groups). Only documents with a window in common, and never fewer, go through the automata.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, rows_within, small_batches, stored, utf8

WINDOW = 10
#: UTF-8 bytes of items in one automaton, at most (a longer item has a block of its own); an automaton takes about 60 bytes a byte of it.
BLOCK_BYTES = 4 << 20
#: Window hashes that one pass over the documents holds.
HASHES = 16 << 20
#: Limits of the cleaning operator: spans of more words than this are removed; a document with more of its words hit than this share goes.
SPAN_WORDS = 10
COVERAGE = 0.5
#: Rows of hit spans that are broadcast at most.
BROADCAST_ROWS = 200_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_FOLD).split()


class Automaton:
    """A generalised suffix automaton over word numbers, with the windows that count as contamination.

    While it is built each state has a small dictionary of what follows; then there is one for all states, which takes a fifth.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self._next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        told = []
        for item, words in items:
            if not words:
                continue
            numbers = [self.ids.setdefault(w, len(self.ids)) for w in words]
            state = 0
            for c in numbers:
                state = self._extend(state, c)
            told.append((item, numbers))
        #: the shortest window, and the lengths of whole items that are shorter than the window
        self.least = min([window, *(len(numbers) for _, numbers in told)])
        self.sizes = sorted({len(numbers) for _, numbers in told if len(numbers) < window})
        #: by (state, length): the items with that window
        self.owners: dict[tuple[int, int], list[int]] = {}
        for item, numbers in told:  # cloning is over, so states stay
            size, state, matched = min(window, len(numbers)), 0, 0
            for i, c in enumerate(numbers):
                state, matched = self._next[state][c], matched + 1
                if matched > size:
                    state = self._suffix(state, size)
                    matched = size
                if i + 1 >= size:
                    held = self.owners.setdefault((state, size), [])
                    if not held or held[-1] != item:
                        held.append(item)
        #: by state and next word's number
        self.step = {state << 32 | c: after for state, then in enumerate(self._next) for c, after in then.items()}
        del self._next

    def _suffix(self, state: int, size: int) -> int:
        """The state of the last `size` words of what the state stands for."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _new(self, length: int, link: int, then: dict[int, int]) -> int:
        self._next.append(then)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, parent: int, c: int, old: int) -> int:
        copy = self._new(self.length[parent] + 1, self.link[old], dict(self._next[old]))
        self.link[old] = copy
        while parent != -1 and self._next[parent].get(c) == old:
            self._next[parent][c] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if (there := self._next[last].get(c)) is not None:
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, c, there)
        state, parent = self._new(self.length[last] + 1, 0, {}), last
        while parent != -1 and c not in self._next[parent]:
            self._next[parent][c] = state
            parent = self.link[parent]
        if parent != -1:
            there = self._next[parent][c]
            self.link[state] = there if self.length[there] == self.length[parent] + 1 else self._clone(parent, c, there)
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit windows as (first word, end) in order, and the items whose windows occur."""
        get = self.ids.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.concatenate([[False], numbers >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= self.least:  # an unknown word resets the automaton, so shorter runs hold no window
                self._stream(numbers[start:end].tolist(), start, spans, items)
        return spans, items

    def _stream(self, numbers: list[int], offset: int, spans: list, items: set) -> None:
        state, matched = 0, 0
        step, link, length, window, least = self.step, self.link, self.length, self.window, self.least
        sizes = [*self.sizes, window]
        for i, c in enumerate(numbers):
            while (after := step.get(state << 32 | c)) is None and state:
                state = link[state]
                matched = length[state]
            if after is not None:
                state = after
                matched += 1
            if matched >= least:
                for size in sizes:
                    if size > matched:
                        break
                    if owners := self.owners.get((self._suffix(state, size), size)):
                        spans.append((offset + i - size + 1, offset + i + 1))
                        items.update(owners)


def window_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A number for each run of so many words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[i : len(words) - size + 1 + i]
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The test items in blocks of bounded size, streamed to the driver one partition at a time."""
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).filter(F.col(id_col).isNotNull()).orderBy(id_col)
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        data = (text or "").encode()
        if block and size + len(data) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, words_of(data)))
        size += len(data)
    yield block


def _scanned(docs: DataFrame, automaton, extra: list[str], work, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton.value
        for batch in batches:
            step = rows_within(batch)
            for start in range(0, batch.num_rows, step):
                yield work(batch.slice(start, step), found)

    return docs.select(*extra).mapInArrow(run, schema)


def _result(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n_words, spans, items = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(n_words, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS), pa.array(items, pa.list_(pa.int64()))],
        names=["doc_id", "n_words", "spans", "items"],
    )


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<long>"


#: What stands for a text where its hits are joined to it: a hash, its bytes and a checksum.
KEY = ("text_hash", "text_bytes", "text_crc")


def _keyed(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    column = F.col(f"`{text}`").cast("string")
    return df.withColumns(dict(zip(names, (F.xxhash64(column), F.octet_length(column), F.crc32(column.cast("binary"))))))


def _meets(some: np.ndarray, known: np.ndarray) -> bool:
    if not len(some) or not len(known):
        return False
    at = np.searchsorted(known, some)
    return bool((known[np.minimum(at, len(known) - 1)] == some).any())


def _candidates(texts: DataFrame, blocks: Iterator[list[tuple[int, list[bytes]]]], window: int) -> tuple[int, DataFrame]:
    """The fewest words of a window, and the different texts (KEY, text) that share a window hash with an item, stored."""
    shortest, room, parts = window, HASHES, []
    held: dict[int, list[np.ndarray]] = {}

    def send() -> None:
        nonlocal room
        known = texts.sparkSession.sparkContext.broadcast({size: np.unique(np.concatenate(found)) for size, found in held.items()})

        def work(batch: pa.RecordBatch, known: dict[int, np.ndarray]) -> pa.RecordBatch:
            hit = []
            for data in utf8(batch.column("text")):
                words = words_of(data)
                hit.append(any(_meets(window_hashes(words, size), own) for size, own in known.items()))
            return batch.filter(pa.array(hit, pa.bool_()))

        parts.append(stored(_scanned(texts, known, ["text"], work, "text string"), "decontaminate-candidates"))
        held.clear()
        room = HASHES

    for block in blocks:
        for _, words in block:
            if words:
                size = min(window, len(words))
                shortest = min(shortest, size)
                found = window_hashes(words, size)
                if room < len(found) and held:
                    send()
                held.setdefault(size, []).append(found)
                room -= len(found)
    send()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return shortest, stored(_keyed(whole, "text", KEY).dropDuplicates(KEY), "decontaminate-candidates")


def _hits(texts: DataFrame, blocks: Callable[[], Iterator[list[tuple[int, list[bytes]]]]], window: int) -> tuple[int, DataFrame]:
    """The fewest words of a window, and (KEY, spans, items) of the texts that any item hits; texts: a column `text`.

    The documents are read once, for the hashes; the automata only see the texts that share one.
    """
    shortest, some = _candidates(texts, blocks(), window)

    def work(batch: pa.RecordBatch, automaton: Automaton) -> pa.RecordBatch:
        found = [automaton.scan(words_of(data)) for data in utf8(batch.column("text"))]
        spans = pa.array([[{"start": a, "end": b} for a, b in _merged(s)] for s, _ in found], _SPANS)
        owners = pa.array([sorted(o) for _, o in found], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), spans, owners], names=[*KEY, "spans", "items"]).filter(pa.array([bool(s) for s, _ in found], pa.bool_()))

    whole = None
    for block in blocks():
        held = texts.sparkSession.sparkContext.broadcast(Automaton(block, window))
        part = stored(_scanned(some, held, [*KEY, "text"], work, "text_hash long, text_bytes int, text_crc long, spans array<struct<start: long, end: long>>, items array<long>"), "decontaminate-block")
        held.destroy()
        whole = part if whole is None else whole.unionByName(part)
    united = whole.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return shortest, stored(united, "decontaminate-hits")


def _with_hits(docs: DataFrame, hits: DataFrame, text_col: str, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """docs with the given columns of their text's hits, and the names these have there."""
    keys = [fresh(docs, k) for k in KEY]
    names = [fresh(docs, f"hit_{c}") for c in columns]
    right = hits.select(*[F.col(k).alias(n) for k, n in zip(KEY, keys)], *[F.col(c).alias(n) for c, n in zip(columns, names)])
    joined = _keyed(docs, text_col, keys).join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, keys, "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], *names), names


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items): a row for each row of docs; spans are merged runs of hit words (end exclusive), items
    the sorted ids of the items with a window in the document.

    Null or wordless texts have no words, and null or wordless items no windows. Repeated items all count; items without id are
    left out. Repeated documents give repeated rows. With no items or documents nothing is hit. Other columns play no part.
    With items beyond one block the hits of all blocks are united by text.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def read() -> Iterator[list[tuple[int, list[bytes]]]]:
        return _blocks(items, item_col, item_text, block_bytes)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = read()
    first = next(blocks)
    if next(blocks, None) is None:

        def work(batch: pa.RecordBatch, automaton: Automaton) -> pa.RecordBatch:
            rows = []
            for text in utf8(batch.column("text")):
                words = words_of(text)
                spans, owners = automaton.scan(words)
                rows.append((len(words), _merged(spans), sorted(owners)))
            return _result(batch.column("doc_id"), rows)

        return _scanned(plain, spark.sparkContext.broadcast(Automaton(first, window)), ["doc_id", "text"], work, _SCHEMA)
    _, hits = _hits(plain.select("text"), read, window)
    joined, (spans, owners) = _with_hits(plain, hits, "text", ["spans", "items"])

    def unite(batch: pa.RecordBatch, _) -> pa.RecordBatch:
        rows = [(len(words_of(t)), _merged([(s["start"], s["end"]) for s in own or ()]), ids or []) for t, own, ids in zip(utf8(batch.column("text")), batch.column(spans).to_pylist(), batch.column(owners).to_pylist())]
        return _result(batch.column("doc_id"), rows)

    return _scanned(joined, spark.sparkContext.broadcast(None), ["doc_id", "text", spans, owners], unite, _SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The fixed result columns of a contamination() table."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    text_ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(text_ids, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, span_words: int = SPAN_WORDS, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contamination: runs of at least span_words hit words (or of as many as the shortest whole item, where items are
    shorter than the window) are cut from the text, each leaving one space; a document with more than the share `coverage` of its
    words hit, or with no word left, goes.

    All columns of docs stay, whatever their names; n_chars, where there is one, follows the text. Clean rows keep their text, nulls
    included, byte for byte. Repeated rows are each judged alike, repeated items count once, and items without id or words not at all.
    An empty table gives no rows, no items leave all rows. With items beyond one block the hits of all blocks on the text as it came
    are united by text before anything is cut or judged.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names, size_col = docs.columns, "n_chars" if "n_chars" in docs.columns else None

    def read() -> Iterator[list[tuple[int, list[bytes]]]]:
        return _blocks(items, item_col, item_text, block_bytes)

    blocks = read()
    first = next(blocks)
    if next(blocks, None) is None:
        whole = Automaton(first, window)
        held, limit = spark.sparkContext.broadcast(whole), (min(span_words, whole.least) if whole.least < window else span_words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = held.value
            for batch in batches:
                step = rows_within(batch)
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    found = [_merged(automaton.scan(words_of(data))[0]) for data in utf8(part.column(text_col))]
                    yield _cleaned(part, found, limit, coverage, text_col, size_col)

        return docs.mapInArrow(run, docs.schema)
    shortest, hits = _hits(docs.select(F.col(text_col).cast("string").alias("text")), read, window)
    joined, (hit,) = _with_hits(docs, hits, text_col, ["spans"])
    limit = min(span_words, shortest) if shortest < window else span_words

    def cut_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = rows_within(batch)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                found = [_merged([(s["start"], s["end"]) for s in spans or ()]) for spans in part.column(hit).to_pylist()]
                yield _cleaned(part.select(names), found, limit, coverage, text_col, size_col)

    return joined.mapInArrow(cut_run, docs.schema)


def _cleaned(batch: pa.RecordBatch, found: list[list[tuple[int, int]]], least: int, coverage: float, text_col: str, size_col: str | None) -> pa.RecordBatch:
    """The batch after its rows' merged hit spans of at least `least` words are cut."""
    texts, stay, sizes = [], [], []
    old_sizes = batch.column(size_col).to_pylist() if size_col else [None] * batch.num_rows
    for data, spans, size in zip(utf8(batch.column(text_col)), found, old_sizes):
        if spans:
            cut = [(a, b) for a, b in spans if b - a >= least]
            stay.append(sum(b - a for a, b in cut) <= coverage * len(words_of(data)))
            data = _without(data, cut)
            size = len(data.decode())
        else:
            stay.append(True)
        texts.append(data)
        sizes.append(size)
    columns = {name: batch.column(name) for name in batch.schema.names}
    columns[text_col] = pa.array(texts, pa.binary()).cast(batch.schema.field(text_col).type)
    if size_col:
        columns[size_col] = pa.array(sizes, pa.int64()).cast(batch.schema.field(size_col).type)
    return pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema).filter(pa.array(stay, pa.bool_()))


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """data without the words of the spans and what stands between them."""
    held = np.frombuffer(data.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : starts[a]].rstrip(b" "))
        at = int(ends[b - 1])
    rest = data[at:]
    return b" ".join([x for x in out if x] + [rest.lstrip(b" ")] if rest else [x for x in out if x])
