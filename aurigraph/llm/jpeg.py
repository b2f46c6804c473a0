"""Media columns as baseline JPEG: bytes become the DC coefficients of flat grey blocks, and come back by decoding the scan.

A payload is laid out 64 blocks wide. Each byte is the mean of one 8x8 block, so with a DC quantiser of 8 its coefficient is
the byte less 128 and the decoder's DC-only thumbnail (one sample a block) is the payload itself. Every row of blocks is a
restart segment; the decoder advances all segments of all images of a batch together, one Huffman symbol at a time, in numpy.
An image is at most 65,535 pixels high, so a payload above 524,224 bytes takes several images, one after the other.

The reader parses any baseline JPEG (Huffman-coded, 8 bit, one or more components, any sampling, with or without restarts,
interleaved or not), skips AC coefficients and returns the DC-only luminance thumbnail.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, utf8

WIDE = 64
ROWS = 8191
#: Code lengths of the luminance DC table that the JPEG standard suggests, by category 0 to 11.
DC_LENGTHS = (2, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9)


def _canonical(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table from its counts by length."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out.append((s, code, length))
            code += 1
        at += n
        code <<= 1
    return out


_DC_COUNTS = bytes(DC_LENGTHS.count(n) for n in range(1, 17))
_DC_SYMBOLS = bytes(sorted(range(12), key=lambda s: (DC_LENGTHS[s], s)))
_AC_COUNTS, _AC_SYMBOLS = bytes([1] + [0] * 15), b"\x00"  # end of block is all there is: one bit, 0
_CODES = np.zeros(12, np.int32)
for _s, _c, _n in _canonical(_DC_COUNTS, _DC_SYMBOLS):
    _CODES[_s] = _c
_LENGTHS = np.array(DC_LENGTHS, np.int32)
#: bits of |difference|, 0 to 255
_CATEGORY = np.array([int(d).bit_length() for d in range(256)], np.int32)


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _marker(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
        + _marker(0xDB, b"\x00" + bytes([8] + [1] * 63))
        + _marker(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * WIDE, 1, 1, 0x11, 0))
        + _marker(0xC4, b"\x00" + _DC_COUNTS + _DC_SYMBOLS)
        + _marker(0xC4, b"\x10" + _AC_COUNTS + _AC_SYMBOLS)
        + _marker(0xDD, struct.pack(">H", WIDE))
        + _marker(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % WIDE if data else WIDE)


def encode(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload; lengths are positive multiples of 64."""
    if not payloads:
        return []
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDE).astype(np.int16)
    heights = []  # of images; those of a payload follow each other
    images = []
    for p in payloads:
        rows = len(p) // WIDE
        own = [min(ROWS, rows - r) for r in range(0, rows, ROWS)]
        heights += own
        images.append(len(own))
    difference = np.diff(samples, axis=1, prepend=np.int16(128)).astype(np.int32)
    category = _CATEGORY[np.abs(difference)]
    extra = np.where(difference < 0, difference + (1 << category) - 1, difference)
    length = _LENGTHS[category] + category + 1
    bits = ((_CODES[category] << category) | extra) << 1  # the end of the block is a 0
    ends = np.cumsum(length, axis=1)
    full = (ends[:, -1] + 7) // 8
    base = np.concatenate([[0], np.cumsum(full)])
    at = (base[:-1, None] * 8 + ends - length).ravel()
    window = bits.ravel() << (24 - length.ravel() - (at & 7)).astype(np.int32)
    first, total = at >> 3, int(base[-1])
    raw = np.bincount(first, window >> 16, total + 2) + np.bincount(first + 1, (window >> 8) & 255, total + 2) + np.bincount(first + 2, window & 255, total + 2)
    raw = raw[:total].astype(np.uint8)
    raw[base[1:] - 1] |= ((1 << (full * 8 - ends[:, -1])) - 1).astype(np.uint8)  # ones fill the last byte of a row
    stuffed = raw == 255
    before = np.cumsum(stuffed) - stuffed
    tops = np.concatenate([[0], np.cumsum(heights)])
    number = np.arange(len(full)) - np.repeat(tops[:-1], heights)
    last = np.zeros(len(full), bool)
    last[tops[1:] - 1] = True
    marks = np.concatenate([[0], np.cumsum(np.where(last, 0, 2))])
    row_of = np.repeat(np.arange(len(full)), full)
    place = np.arange(total) + before + marks[row_of]
    out = np.zeros(total + int(stuffed.sum()) + int(marks[-1]), np.uint8)
    out[place] = raw
    row_end = place[base[1:] - 1] + 1 + stuffed[base[1:] - 1]
    inner = np.flatnonzero(~last)
    out[row_end[inner]] = 255
    out[row_end[inner] + 1] = 0xD0 + number[inner] % 8
    scans, blob = np.concatenate([[0], row_end[tops[1:] - 1]]).tolist(), out.tobytes()
    single = [_header(h) + blob[scans[i] : scans[i + 1]] + b"\xff\xd9" for i, h in enumerate(heights)]
    edges = np.concatenate([[0], np.cumsum(images)]).tolist()
    return [b"".join(single[a:b]) for a, b in zip(edges, edges[1:])]


class NotBaseline(ValueError):
    """The bytes are no JPEG, or not a baseline one."""


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """Size, layout, tables and scans of the image that starts at `at`, and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    at += 2
    quant, huffman, frame, restart, scans = {}, {}, None, 0, []
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise NotBaseline("a marker is missing")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # DC only
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xC0:
            precision, height, width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise NotBaseline("samples are not 8 bit")
            frame = (width, height, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC1 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise NotBaseline("the frame is not baseline")
        elif kind == 0xDA:
            n = body[0]
            chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise NotBaseline("the scan has no end")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                elif data[end + 1] == 0xFF:
                    end += 1
                else:
                    break
            scans.append((chosen, restart, dict(huffman), data[at:end]))
            at = end
    if frame is None or not scans:
        raise NotBaseline("no frame or no scan")
    return {"width": frame[0], "height": frame[1], "components": frame[2], "quant": quant, "scans": scans}, at + 2


@lru_cache(maxsize=64)
def _lookup(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0 for what is no code."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, code, n in _canonical(*table):
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


def _job(image: dict) -> tuple[tuple, dict]:
    """What of an image's scans holds luminance: (layout, work). Images of equal layout are decoded together."""
    lead = image["components"][0]
    for chosen, restart, huffman, data in image["scans"]:
        if lead[0] not in [c for c, _, _ in chosen]:
            continue
        by_id = {c[0]: c for c in image["components"]}
        hmax, vmax = max(c[1] for c in image["components"]), max(c[2] for c in image["components"])
        if len(chosen) == 1:  # not interleaved: single blocks over the component's own size
            across = -(-(-(-image["width"] * lead[1] // hmax)) // 8)
            down = -(-(-(-image["height"] * lead[2] // vmax)) // 8)
            schedule, h, v = [(lead[0], *chosen[0][1:])], 1, 1
        else:
            across, down = -(-image["width"] // (8 * hmax)), -(-image["height"] // (8 * vmax))
            schedule = [(c, dc, ac) for c, dc, ac in chosen for _ in range(by_id[c][1] * by_id[c][2])]
            h, v = lead[1], lead[2]
        tables = tuple(sorted({**{("d", dc): huffman[dc] for _, dc, _ in schedule}, **{("a", ac): huffman[16 + ac] for _, _, ac in schedule}}.items()))
        return (tuple(schedule), lead[0], tables), {"data": data, "units": across * down, "restart": restart or across * down, "across": across, "down": down, "h": h, "v": v, "q": image["quant"].get(lead[3], 1)}
    raise NotBaseline("no scan of luminance")


def _bits(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and markers, where each restart segment starts, and how many each scan has."""
    joined = np.frombuffer(b"".join(s + b"\xff\xd0" for s in scans), np.uint8)  # a mark after each scan too
    after = np.concatenate([[False], joined[:-1] == 255])
    mark = after & (joined >= 0xD0) & (joined <= 0xD7)
    drop = after & (joined == 0) | mark
    drop[:-1] |= mark[1:]
    kept = np.cumsum(~drop)
    ends = kept[np.flatnonzero(mark)]
    counts = np.add.reduceat(mark.astype(np.int64), np.cumsum([0] + [len(s) + 2 for s in scans[:-1]]))
    return joined[~drop], np.concatenate([[0], ends[:-1]]), counts


@lru_cache(maxsize=64)
def _flat_blocks(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> np.ndarray:
    """By the next 16 bits: difference * 32 + bits of a block that ends right after its DC coefficient; 0 if 16 bits don't tell."""
    symbol, length = _lookup(dc)
    ends = {n: code for s, code, n in _canonical(*ac) if s == 0}
    bits = np.arange(1 << 16)
    cat = symbol
    left = 16 - length - cat
    good = (length > 0) & (left > 0)
    left = np.where(good, left, 0)
    extra = (bits >> left) & ((1 << cat) - 1)
    difference = np.where(extra < ((1 << cat) >> 1), extra - (1 << cat) + 1, extra)
    out = np.zeros(1 << 16, np.int32)
    for n, code in ends.items():
        hit = good & (left >= n) & ((bits >> np.maximum(left - n, 0)) & ((1 << n) - 1) == code)
        out[hit] = (difference * 32 + length + cat + n)[hit]
    return out


def _decode(layout: tuple, jobs: list[dict]) -> list[np.ndarray]:
    """DC-only luminance of images of one layout; lanes are restart segments, which advance together."""
    schedule, lead, tables = layout
    tables = dict(tables)
    data, starts, counts = _bits([j["data"] for j in jobs])
    for j, n in zip(jobs, counts.tolist()):
        if n != -(-j["units"] // j["restart"]):
            raise NotBaseline("restart segments are missing")
    kind = np.int32 if len(data) < 1 << 27 else np.int64
    padded_data = np.concatenate([data, np.full(16, 255, np.uint8)])
    four = padded_data.astype(np.uint32)
    near = (four[:-3] << 24 | four[1:-2] << 16 | four[2:-1] << 8 | four[3:]) >> 1  # bit positions need 31 bits at most
    near = near.astype(np.int32)
    units = np.concatenate([np.minimum(j["restart"], j["units"] - j["restart"] * np.arange(n)) for j, n in zip(jobs, counts.tolist())])
    order = np.argsort(-units, kind="stable")  # lanes that end first are last, so those still at work are a prefix
    falling = -units[order]
    at = starts[order].astype(kind) * 8
    per = sum(c == lead for c, _, _ in schedule)
    out = np.zeros((int(units.max()), per, len(units)), np.int32)
    held = {c: np.zeros(len(units), np.int32) for c, _, _ in schedule}
    most = kind(len(data))
    for unit in range(int(units.max())):
        lanes = int(np.searchsorted(falling, -unit, side="left"))
        k = 0
        for component, dc, ac in schedule:
            here = at[:lanes]
            code = (near[np.minimum(here >> 3, most)] >> (15 - (here & 7))) & 0xFFFF
            flat = _flat_blocks(tables["d", dc], tables["a", ac])[code]
            here += flat & 31
            sums = held[component][:lanes]
            sums += flat >> 5
            if len(hard := np.flatnonzero(flat == 0)):
                at[hard], sums[hard] = _block(padded_data, at[hard].astype(np.int64), sums[hard], _lookup(tables["d", dc]), _lookup(tables["a", ac]))
            if component == lead:
                out[unit, k, :lanes] = sums
                k += 1
    by_lane = np.empty((len(units), int(units.max()), per), np.int32)
    by_lane[order] = out.transpose(2, 0, 1)
    images, lane = [], 0
    for j, n in zip(jobs, counts.tolist()):
        own = by_lane[lane : lane + n, : j["restart"]].reshape(-1, per)[: j["units"]]
        lane += n
        grid = own.reshape(j["down"], j["across"], j["v"], j["h"]).transpose(0, 2, 1, 3).reshape(j["down"] * j["v"], j["across"] * j["h"])
        images.append(np.clip((grid * j["q"] + 4) // 8 + 128, 0, 255).astype(np.uint8))
    return images


def _next(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 32 bits from each bit position."""
    i = np.minimum(at >> 3, len(data) - 6)[:, None] + np.arange(5)
    wide = (data[i].astype(np.int64) << np.array([32, 24, 16, 8, 0])).sum(1)
    return (wide >> (8 - (at & 7))) & 0xFFFFFFFF


def _block(data: np.ndarray, at: np.ndarray, held: np.ndarray, dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Any block: positions after it and the new DC values of the lanes."""
    x = _next(data, at)
    cat, n = dc[0][x >> 16], dc[1][x >> 16]
    if n.min() == 0:
        raise NotBaseline("no such code")
    extra = (x >> (32 - n - cat)) & ((1 << cat) - 1)
    held = held + np.where(extra < ((1 << cat) >> 1), extra - (1 << cat) + 1, extra)
    at = at + n + cat
    busy, k = np.arange(len(at)), np.ones(len(at), np.int64)
    while len(busy):
        code = _next(data, at[busy]) >> 16
        s, n = ac[0][code], ac[1][code]
        if n.min() == 0:
            raise NotBaseline("no such code")
        at[busy] += n + (s & 15)
        k = k + (s >> 4) + 1
        stay = (s != 0) & (k < 64)
        busy, k = busy[stay], k[stay]
    return at, held


def decode(blobs: list[bytes]) -> list[list[dict]]:
    """For each stored form its images: width, height, where its bytes stand and the DC-only luminance thumbnail."""
    groups: dict[tuple, list[tuple[int, int, dict]]] = defaultdict(list)
    found: list[list[dict]] = []
    for i, blob in enumerate(blobs):
        at, own = 0, []
        while at < len(blob):
            start = at
            image, at = parse(blob, at)
            layout, job = _job(image)
            groups[layout].append((i, len(own), job))
            own.append({"width": image["width"], "height": image["height"], "span": slice(start, at)})
        found.append(own)
    for layout, jobs in groups.items():
        for (i, n, _), thumbnail in zip(jobs, _decode(layout, [j for _, _, j in jobs])):
            found[i][n]["thumbnail"] = thumbnail
    return found


def average_hash(thumbnail: np.ndarray) -> int:
    """64 bits: which of 8x8 cells are lighter than all cells' mean."""
    h, w = thumbnail.shape
    down, across = (np.arange(8) * h // 8, np.arange(8) * w // 8)
    rows = np.add.reduceat(thumbnail.astype(np.int64), down, axis=0) if h >= 8 else thumbnail.astype(np.int64)[down]
    cells = np.add.reduceat(rows, across, axis=1) if w >= 8 else rows[:, across]
    area = (np.diff(np.append(down, h)) if h >= 8 else np.ones(8, int))[:, None] * (np.diff(np.append(across, w)) if w >= 8 else np.ones(8, int))
    mean = cells / area
    return int(np.packbits((mean > mean.mean()).ravel()).view(">u8")[0])


def features(images: list[dict]) -> str:
    """Width, height and average hash of each image, in order."""
    return ";".join(f"{x['width']}x{x['height']}:{average_hash(x['thumbnail']):016x}" for x in images)


#: Payload bytes whose images are packed or read together; an image takes about a hundred bytes of memory for each of its payload.
TOGETHER = 1 << 19
_IMAGE = WIDE * ROWS


def _stored_form(payload: bytes) -> Iterator[bytes]:
    """The images of one payload, one after the other."""
    for start in range(0, len(payload), _IMAGE):
        yield encode([payload[start : start + _IMAGE]])[0]


def _in_groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of the list of about TOGETHER bytes each; what is larger stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > TOGETHER:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def _encoded(texts: list[bytes]) -> list[bytes]:
    payloads, out = [padded(t) for t in texts], []
    for a, b in _in_groups([len(p) for p in payloads]):
        out += encode(payloads[a:b]) if b - a > 1 else [b"".join(_stored_form(payloads[a]))]
    return out


def as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as JPEG. A null or empty text is 64 zero bytes; equal texts give equal media.

    One row for each row of docs, nulls in ids included; an empty table gives no rows; other columns play no part.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in utf8(batch.column("text"))]
        media = pa.array(_encoded(texts), pa.large_binary()).cast(pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), work, "doc_id long, n_bytes long, media binary")


def _images(blob: bytes) -> Iterator[bytes]:
    """Each image of a stored form by itself."""
    at = 0
    while at < len(blob):
        _, end = parse(blob, at)
        yield blob[at:end]
        at = end


def _summary(images: Iterable[tuple[bytes, dict]]) -> tuple:
    """The result columns of one stored form from its images, each as bytes and as decoded."""
    payload, media, n, size, tail, seen = hashlib.sha256(), hashlib.sha256(), 0, 0, b"", []
    for blob, image in images:
        own = image["thumbnail"].tobytes()
        payload.update(own)
        media.update(blob)
        n, size, tail = n + len(own), size + len(blob), (tail + own)[-64:]
        seen.append(features([image]))
    return n, payload.hexdigest(), zlib.crc32(tail), size, media.hexdigest(), ";".join(seen)


def _one_by_one(blobs: Iterator[bytes]) -> Iterator[tuple[bytes, dict]]:
    for blob in blobs:
        yield blob, decode([blob])[0][0]


def _read(blobs: list[bytes | None]) -> list[tuple]:
    """The result columns of each stored form; nulls for one that is null, empty or no baseline JPEG throughout."""
    rows: list[tuple] = [(None,) * len(_READ)] * len(blobs)
    for a, b in _in_groups([len(x or b"") for x in blobs]):
        try:
            if b - a > 1:
                read = decode([x or b"" for x in blobs[a:b]])
                rows[a:b] = [_summary((x[i["span"]], i) for i in images) if images else (None,) * len(_READ) for x, images in zip(blobs[a:b], read)]
            elif blobs[a]:
                rows[a] = _summary(_one_by_one(_images(blobs[a])))
        except (NotBaseline, KeyError, IndexError, ValueError, struct.error):
            if b - a > 1:  # the others are read by themselves
                rows[a:b] = [_read([x])[0] for x in blobs[a:b]]
    return rows


_READ = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
_READ_SQL = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame) -> DataFrame:
    """The columns of as_media() with payload and features read back from the stored bytes instead of the bytes.

    Media that are null or no baseline JPEG have nulls there.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = _read(batch.column("media").to_pylist())
        columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_READ)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *(n for n, _ in _READ)])

    return by_batch(media.select("doc_id", "n_bytes", "media"), work, f"doc_id long, n_bytes long, {_READ_SQL}")


def _features_of(texts: list[bytes]) -> list[tuple]:
    """The result columns of texts; a long one is packed and read image by image."""
    payloads, rows = [padded(t) for t in texts], []
    for a, b in _in_groups([len(p) for p in payloads]):
        if b - a > 1:
            rows += _read(encode(payloads[a:b]))
        else:
            rows.append(_summary(_one_by_one(_stored_form(payloads[a]))))
    return rows


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """read_media(as_media(docs)) in one pass, so that the media need not leave the worker.

    One row for each row of docs; nulls and empty texts are 64 zero bytes, an empty table gives no rows, other columns play no part.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in utf8(batch.column("text"))]
        rows = _features_of(texts)
        columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_READ)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), *columns], names=["doc_id", "n_bytes", *(n for n, _ in _READ)])

    return by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), work, f"doc_id long, n_bytes long, {_READ_SQL}", most_bytes=1 << 20)
