"""Main text of web pages: differencing with the pages of nearest URL, and markup rules as a second voice.

A page is cut into lines, one for each block of text. A line has two signs: its text, and its shape, which is the path of block
elements around it with their classes and roles. Within each host, the different pages stand in the order of their URL paths, and
each is aligned with the one before and the one after by longest common subsequence, once over texts and once over runs of
equal shapes. A line whose text is shared is a frame and goes. A line whose shape is shared goes too, unless it is in
the section that holds most of the page's text: menus, adverts and footers keep their shape from page to page, whatever they say.
Lines of a declared article (``main`` or ``article``, if it holds at least ``DECLARED`` of the text) take no part in differencing:
what two articles have in common is no frame.

The second voice decides what differencing cannot, as on a host with one page: what is declared as menu, header, footer, sidebar,
notice, advert, form or comment by tag, role or class goes, and beside a declared article everything else.

Parsing is linear in the page: a tag is read by one pass over its attributes, an end that is missing is looked for once, and
what an element needs of those around it is kept with it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, stored

#: Elements by what they do to text.
RAW = frozenset("script style template title textarea iframe noembed noframes".split())
SKIPPED = frozenset("noscript svg select button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul xmp".split())
SECTION = frozenset("article aside body details dialog div fieldset footer form head header html main menu nav search section table td th".split())
FRAME = frozenset("nav footer aside form menu dialog search fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names that mark what is no article.
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead toolbar pagination pager skiplink comment comments commentlist reply replies respond disqus discussion share sharing social related recommended".split()
)
#: Parts that say nothing by themselves; within an article a name counts only if the rest of it is of these.
PLAIN = frozenset("area articles bar block box button buttons container content form inner item items link links list outer panel posts section slot thread top bottom unit wrap wrapper".split())
#: Those that only count outside an article, which may have a header of its own.
HEADS = frozenset("header".split())
#: The part of a page's text that a main or article must hold to be its declared article.
DECLARED = 0.5
#: Cells of the table of a common subsequence that are held at once; beyond, it is halved.
CELLS = 1 << 26

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>")
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NUMBER = re.compile(r"[0-9]+")
_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)")

#: (text, region, framed, shape, section, characters outside links); region: 2 in a main, 1 in an article, 0 elsewhere.
Line = tuple[str, int, bool, int, int, int]


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(name.lower(), "".join(values)) for name, *values in _ATTR.findall(text)] if "=" in text else []


def _framing(tag: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
    """Whether an element is declared to hold no article text; inside: it is in a main or article."""
    if tag in FRAME or (tag in HEADS and not inside):
        return True
    if tag in ("body", "html", "main", "article"):
        return False
    for name, value in attributes:
        if name == "role":
            if value.strip().lower() in ROLES:
                return True
            continue
        for token in value.split():
            parts = {p.lower() for p in _PART.findall(_CAMEL.sub(" ", token))}
            if parts & NAMES and (not inside or parts <= NAMES | PLAIN):
                return True
            if not inside and parts & HEADS:
                return True
    return False


def _shape(above: int, tag: str, attributes: list[tuple[str, str]]) -> int:
    """A number for the path to an element: tags, classes and roles, numbers in them aside."""
    kinds = sorted(_NUMBER.sub("0", v).lower() for n, value in attributes if n != "id" for v in value.split())
    return xxhash.xxh64_intdigest(f"{tag}.{'.'.join(kinds)}".encode(), above)


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def lines(page: str | None) -> list[Line]:
    """The blocks of text of a page, in order."""
    page = page or ""
    out: list[Line] = []
    piece: list[str] = []
    plain = 0
    opened: Counter[str] = Counter()
    missing: set[str] = set()
    # tag, framed, region, shape, section, place of the open p and li that a new one would end
    top = ("", False, 0, 0, 0, -1, -1)
    stack: list[tuple] = []
    at, end = 0, len(page)

    def close() -> None:
        nonlocal plain
        if piece:
            if text := " ".join("".join(piece).split()):
                out.append((text, top[2], top[1], top[3], top[4], plain))
            piece.clear()
        plain = 0

    def say(text: str) -> None:
        nonlocal plain
        piece.append(text)
        if not opened["a"]:
            plain += len(text.strip())

    def cut(place: int) -> None:
        nonlocal top
        for gone in stack[place:]:
            opened[gone[0]] -= 1
        del stack[place:]
        top = stack[-1] if stack else ("", False, 0, 0, 0, -1, -1)

    while at < end:
        start = page.find("<", at)
        upto = end if start < 0 else start
        if upto > at:
            say(html.unescape(page[at:upto]))
        if start < 0:
            break
        follows = page[start + 1 : start + 3]
        if follows[:1] in "!?" and follows or (follows[:1] == "/" and not follows[1:].isalpha()):
            comment = page.startswith("<!--", start)
            done = page.find("-->" if comment else ">", start + (4 if comment else 1))
            at = end if done < 0 else done + (3 if comment else 1)
            continue
        if not (follows[:1].isascii() and follows[:1].isalpha() or follows[:1] == "/" and follows[1:].isascii()):
            say("<")
            at = start + 1
            continue
        m = _TAG.match(page, start)
        if not m:  # no end of the tag up to the end of the page
            break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                close()
            elif tag == "br":
                say(" ")
            if opened[tag]:
                place = len(stack) - 1
                while stack[place][0] != tag:
                    place -= 1
                cut(place)
            continue
        if tag in RAW or tag in SKIPPED:
            if m[3].endswith("/") or tag in missing:
                continue
            if done := _closing(tag).search(page, at):
                at = done.end()
            elif tag in RAW:
                break
            else:
                missing.add(tag)
            continue
        if tag == "br":
            say(" ")
        attributes = _attributes(m[3])
        if tag in BLOCK:
            close()
            if tag == "p" and top[5] >= 0:
                cut(top[5])
            elif tag == "li" and top[6] >= 0:
                cut(top[6])
        if tag in VOID:
            continue
        _, framed, region, shape, section, p, li = top
        region = 2 if tag == "main" else max(region, 1) if tag == "article" else region
        if tag in BLOCK:
            shape = _shape(shape, tag, attributes)
            p, li = (len(stack) if tag == "p" else -1), (len(stack) if tag == "li" else -1)
        if tag in SECTION:
            section = shape
        top = (tag, framed or _framing(tag, attributes, region > 0), region, shape, section, p, li)
        stack.append(top)
        opened[tag] += 1
        if tag == "xmp":
            done = _closing(tag).search(page, at)
            say(page[at : done.start() if done else end])
            close()
            cut(len(stack) - 1)
            at = done.end() if done else end
    close()
    return out


def declared(found: list[Line]) -> int:
    """The region of the page's declared article, or 0: the highest that holds enough of what is no frame."""
    sizes = [0, 0, 0]
    for text, region, framed, *_ in found:
        if not framed:
            sizes[region] += len(text)
    for region in (2, 1):
        if sizes[region] and sizes[region] >= DECLARED * sum(sizes):
            return region
    return 0


def signs(found: list[Line], markup: bool = True) -> tuple[list[int], list[int], list[int]]:
    """Of the lines that differencing may take: their places, text signs and shape signs. A shape sign is 0 for lines of the section
    with most text. Without markup no article counts as declared."""
    region = declared(found) if markup else 0
    weights: Counter[int] = Counter()
    for *_, section, plain in found:
        weights[section] += plain
    heavy = max(weights, key=lambda s: (weights[s], s), default=None)
    at, texts, shapes = [], [], []
    for i, (text, own, framed, shape, section, _) in enumerate(found):
        if region and own == region and not framed:
            continue
        at.append(i)
        texts.append(xxhash.xxh64_intdigest(text.encode()) - (1 << 63))
        shapes.append(0 if section == heavy and not region else shape - (1 << 63) or 1)
    return at, texts, shapes


def kept_lines(found: list[Line]) -> list[bool]:
    """Which lines the markup lets stand."""
    region = declared(found)
    return [not framed and (not region or own == region) for _, own, framed, *_ in found]


def _rows(a: list[int], b: list[int], where: dict[int, int]) -> list[int]:
    """Bit vectors over a after each of b: a bit is 0 where the length of the common subsequence grows."""
    full = (1 << len(a)) - 1
    row, out = full, []
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        out.append(row)
    return out


def _places(a: list[int]) -> dict[int, int]:
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def _growth(row: int, n: int) -> np.ndarray:
    """Length of the common subsequence with each prefix of a."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _common(a: list[int], b: list[int], offset: int, out: set[int]) -> None:
    if not a or not b:
        return
    if len(a) * len(b) > CELLS and len(b) > 1:  # halves of b, met where the two parts of a are longest together
        half, full = len(b) // 2, (1 << len(a)) - 1
        ends = []
        for own, other in ((a, b[:half]), (a[::-1], b[half:][::-1])):
            where, row = _places(own), full
            for x in other:
                hit = row & where.get(x, 0)
                row = ((row + hit) | (row - hit)) & full
            ends.append(_growth(row, len(a)))
        split = int((ends[0] + ends[1][::-1]).argmax())
        _common(a[:split], b[:half], offset, out)
        _common(a[split:], b[half:], offset + split, out)
        return
    rows = _rows(a, b, _places(a))
    i = len(a) - 1  # walk back: a zero bit that the row before lacks is where the length grew
    for j in range(len(b) - 1, -1, -1):
        zeros = ~rows[j] & ((1 << (i + 1)) - 1)
        if not zeros:
            break
        i = zeros.bit_length() - 1
        before = rows[j - 1] if j else (1 << len(a)) - 1
        if before >> i & 1:
            out.add(offset + i)
            i -= 1


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b, by bit vectors over a."""
    here, there = set(b), set(a)
    places = [i for i, x in enumerate(a) if x in here]  # others are in no common subsequence
    found: set[int] = set()
    _common([a[i] for i in places], [x for x in b if x in there], 0, found)
    return {places[i] for i in found}


def _runs(shapes: list[int]) -> tuple[list[int], list[list[int]]]:
    """Runs of equal shapes, without 0: the shape and the positions of each."""
    kinds: list[int] = []
    members: list[list[int]] = []
    for i, x in enumerate(shapes):
        if not x:
            continue
        if kinds and kinds[-1] == x and members[-1][-1] == i - 1:
            members[-1].append(i)
        else:
            kinds.append(x)
            members.append([i])
    return kinds, members


def shared(texts: list[int], shapes: list[int], others: list[tuple[list[int], list[int]]]) -> set[int]:
    """Positions of the lines that a page shares, by text or by shape, with one of its neighbours (texts, shapes)."""
    kinds, members = _runs(shapes)
    gone: set[int] = set()
    for other_texts, other_shapes in others:
        gone |= common_lines(texts, other_texts)
        for run in common_lines(kinds, _runs(other_shapes)[0]):
            gone.update(members[run])
    return gone


def _site(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m[1].lower(), m[2]) if m else ("", url or "")


_PARSED = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("mark", pa.int64()), ("lines", pa.list_(pa.string())),
    ("at", pa.list_(pa.int32())), ("texts", pa.list_(pa.int64())), ("shapes", pa.list_(pa.int64())),
])
_PARSED_SQL = "page_id long, url string, host string, path string, mark long, lines array<string>, at array<int>, texts array<long>, shapes array<long>"


def _parsed(pages: DataFrame, markup: bool) -> DataFrame:
    """Each page's host and path, its lines (empty where the markup lets them not stand) and their signs; `mark` is a number for
    the host, the signs and how many lines there are, so that what goes of one page goes of all with its mark."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            found = lines(page)
            at, texts, shapes = signs(found, markup)
            host, path = _site(url)
            stand = kept_lines(found) if markup else [True] * len(found)
            mark = xxhash.xxh64_intdigest(np.array([len(found), *at, *texts, *shapes], np.int64).tobytes() + host.encode()) - (1 << 63)
            rows.append((page_id, url, host, path, mark, [x[0] if s else "" for x, s in zip(found, stand)], at, texts, shapes))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARSED)], schema=_PARSED) if rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _PARSED], schema=_PARSED)

    return by_batch(pages, work, _PARSED_SQL)


def _neighbours(reps: DataFrame) -> DataFrame:
    """reps with the signs of the page before and after in the order of URL paths within the host.

    Pages are dealt by ranges of (host, path), so a large host is many tasks; where a range begins or ends in a host, the
    page beyond comes from a table of the ranges' ends, one row for each range.
    """
    pieces = max(1, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(reps.repartitionByRange(pieces, "host", "path", "mark").withColumn("piece", F.spark_partition_id()), "html-signs")
    within = Window.partitionBy("piece").orderBy("host", "path", "mark")
    one, place = F.struct("host", "texts", "shapes"), F.struct("host", "path", "mark")
    placed = dealt.withColumn("before", F.lag(one).over(within)).withColumn("after", F.lead(one).over(within))
    ends = dealt.groupBy("piece").agg(F.min_by(one, place).alias("first"), F.max_by(one, place).alias("last"))
    ordered = Window.orderBy("piece")  # one row for each range
    beyond = ends.select("piece", F.lag("last").over(ordered).alias("earlier"), F.lead("first").over(ordered).alias("later"))
    whole = placed.join(beyond, "piece").withColumn("before", F.coalesce("before", "earlier")).withColumn("after", F.coalesce("after", "later"))
    return whole.select("mark", "lines", "at", "texts", "shapes", *[F.when(F.col(f"{x}.host") == F.col("host"), F.col(x)).alias(x) for x in ("before", "after")]).filter("before IS NOT NULL OR after IS NOT NULL")


def _dropped(batch: pa.RecordBatch) -> pa.RecordBatch:
    gone = []
    for n, at, texts, shapes, *others in zip(*(batch.column(c).to_pylist() for c in ("lines", "at", "texts", "shapes", "before", "after"))):
        found = shared(texts, shapes, [(o["texts"], o["shapes"]) for o in others if o])
        flags = np.zeros(n, bool)
        if len(found) < n:  # a page that its neighbours repeat whole is kept
            flags[[at[i] for i in found]] = True
        gone.append(flags)
    return pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(gone, pa.list_(pa.bool_()))], names=["mark", "gone"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = 100_000, markup: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of pages; text is the page's blocks joined by one space.

    Null and empty pages have the text ''. Null, relative or odd URLs count as one host without a name. Pages of one host with equal
    signs, as repeated rows and mirrored paths, stand once among their neighbours, at the first of their paths, so that copies do
    not hide the pages beside them. An empty table gives no rows. Other columns play no part.

    Each page is parsed once; its text is stored, and what goes of it, found from the signs alone, is joined by mark: broadcast as far as
    `broadcast_rows` pages share lines, and shuffled beyond. Without markup only differencing decides.
    """
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = stored(_parsed(plain, markup), "html-lines")
    reps = parsed.filter("size(at) > 0").groupBy("host", "mark").agg(F.min("path").alias("path"), F.first(F.struct(F.size("lines").alias("lines"), "at", "texts", "shapes")).alias("signs"))
    near = _neighbours(reps.select("host", "mark", "path", "signs.*"))
    drops = stored(by_batch(near, _dropped, "mark long, gone array<boolean>"), "html-drops")
    n = drops.count()
    rows = parsed.select("page_id", "url", "mark", "lines").join(F.broadcast(drops) if n <= broadcast_rows else drops, "mark", "left")
    stays = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.zip_with("lines", "gone", lambda line, gone: F.when(gone, "").otherwise(line)))
    text = F.array_join(F.filter(stays, lambda line: line != ""), " ")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
