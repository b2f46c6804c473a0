"""Each operator on odd tables and against plain brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import xxhash

from aurigraph.llm import chat, components, decontaminate, htmltext, jpeg, langid, mixing, pii, quality, sharding, simhash
from aurigraph.llm.common import discard, shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_fingerprint(text: str | None, k: int = 3) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(marks: dict[int, int], bits: int) -> dict[int, int]:
    parent = {d: d for d in marks}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(marks)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= bits:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


# op 1


def test_simhash_is_brute_force(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    marks = {d: plain_fingerprint(t) for d, t in texts.items()}
    found = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(documents).collect()}
    assert found == {d: (marks[d], g) for d, g in plain_groups(marks, 2).items()}


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.fp, r.component_id))
    assert len(rows) == 11 and all(len(v) == 1 for v in by_id.values())
    assert by_id[1] == by_id[2] == by_id[8]  # A-Z is folded
    assert by_id[3] == by_id[4] == by_id[9] == {(0, 3)}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 10]


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_with_crowded_buckets(spark, monkeypatch, bits):
    """Families of near fingerprints, with buckets beyond the limit, keep the components of all pairs."""
    rng = random.Random(bits)
    marks = set()
    for _ in range(4):
        seed = rng.getrandbits(64)
        for _ in range(25):
            x = seed
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            marks.add(x)
    monkeypatch.setattr(simhash, "DENSE", 3)
    ids = {i: m for i, m in enumerate(sorted(marks))}
    signed = {i: m - 2**64 if m >= 2**63 else m for i, m in ids.items()}
    fps = spark.createDataFrame([(m,) for m in signed.values()], "fp long")
    edges = simhash.links(fps, bits)
    at = {m: i for i, m in signed.items()}
    pairs = [(at[r.a], at[r.b]) for r in edges.collect()]
    assert all((ids[a] ^ ids[b]).bit_count() <= bits for a, b in pairs)
    want = plain_groups(ids, bits)
    edge_rows = spark.createDataFrame(pairs or [(0, 0)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edge_rows).collect()}
    assert {i: got.get(i, i) for i in ids} == want


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Edges that already are stars are settled, others are not, and what a round made is deleted."""
    rounds, large = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or large(edges))
    shared_dir(spark)  # the first call names the folder, later ones Spark's own in it
    folder = Path(shared_dir(spark).removeprefix("file:")) / "aurigraph"
    before = set(folder.glob("components*"))
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    for rows, want, most in (([(1, 2), (3, 1), (8, 7), (2, 1), (5, 5)], {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}, 0), ([], {}, 0), ([(1, 2), (2, 3)], {1: 1, 2: 1, 3: 1}, 1), ([(1, 3), (2, 3)], {1: 1, 2: 1, 3: 1}, 1)):
        rounds.clear()
        found = components.connected_components(frame(rows))
        assert {r.node: r.component for r in found.collect()} == want and len(rounds) == most
        assert len(set(folder.glob("components*")) - before) == 1
        discard(found)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# op 2


def test_language_held_out_accuracy(spark, documents):
    rows = langid.identify(documents).join(documents.select("doc_id", "lang", "text"), "doc_id").collect()
    long_enough = [r for r in rows if r.held_out and r.lang and len(r.text) > 60]
    assert sum(r.lang_pred == r.lang for r in long_enough) >= 0.9 * len(long_enough)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_letters_and_ties(spark):
    assert not any(map(langid.has_letter, ("\u00bd \u00b2 \u2167 12", "", "!?_", "\u0663"))) and all(map(langid.has_letter, ("a", "1 \u00df", "\u4e2d", "\u02b0")))
    same = langid.Packer({"b": b"one and the same text", "a": b"one and the same text"})
    assert same("the same text")[:2] == ("a", 0.0) and same("\u00bd")[0] == "und"


def test_language_sizes_are_brute_force(spark, documents):
    """Each text's sizes under each dictionary, packed anew piece by piece."""
    import zstandard

    fitted = langid.fit(documents.filter(~langid.held_out()))
    assert all(len(d) <= langid.DICTIONARY_BYTES for d in fitted.values())
    found = {r.doc_id: r for r in langid.predict(documents, fitted).collect()}
    for r in documents.limit(40).collect():
        data = langid.folded(r.text or "")
        if not langid.has_letter(r.text or ""):
            assert found[r.doc_id].lang_pred == "und"
            continue
        sizes = {}
        for lang, content in fitted.items():
            box = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(box.compress(data[i : i + langid.PIECE_BYTES])) for i in range(0, max(1, len(data)), langid.PIECE_BYTES))
        first, second = sorted((n, lang) for lang, n in sizes.items())[:2]
        assert found[r.doc_id].lang_pred == first[1] and found[r.doc_id].score == pytest.approx(1 - first[0] / second[0], abs=0.02)


def test_language_odd_rows(odd, empty):
    found = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert found[3].lang_pred == found[4].lang_pred == found[7].lang_pred == found[9].lang_pred == "und"
    assert found[7].score == 0
    assert langid.identify(odd).count() == 11 and langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}


# op 3


def plain_kneser_ney(texts: list[str], order: int = quality.ORDER):
    """Interpolated modified Kneser-Ney over characters, by dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        s = chr(quality.BEGIN) * (order - 1) + t
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = [sum(1 for v in c.values() if v == i) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        discounts[k] = [min(float(i), max(0.1, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] and n[i] else i / 2 for i in (1, 2, 3)]
    kinds = len(counts[1])
    context = {k: defaultdict(lambda: [0.0, 0.0]) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            context[k][g[:-1]][0] += v
            context[k][g[:-1]][1] += discounts[k][min(v, 3) - 1]

    def p(g: str) -> float:
        k = len(g)
        if k == 0:
            return 1.0 / (kinds + 1)
        if g[:-1] not in context[k]:
            return p(g[1:])
        total, left = context[k][g[:-1]]
        v = counts[k].get(g, 0)
        own = (v - discounts[k][min(v, 3) - 1]) / total if v else 0.0
        return own + left / total * p(g[1:])

    def perplexity(t: str) -> float:
        s = chr(quality.BEGIN) * (order - 1) + t
        return math.exp(-sum(math.log(p(s[i : i + order])) for i in range(len(t))) / len(t))

    return perplexity


def test_quality_is_brute_force_on_either_path(spark):
    rng = random.Random(5)
    words = ["the", "and", "over", "river", "ß", "né", "\U0001f600", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 20))) for _ in range(60)] + ["zzqq!!", "a"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(1, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    want = plain_kneser_ney([units(t) for i, t in enumerate(texts) if i % 2 == 0 and i < 60])
    for most in (quality.BROADCAST_ROWS, 0):
        found = {r.doc_id: r.perplexity for r in quality.judge(docs, labels, broadcast_rows=most).collect()}
        assert all(found[i] == pytest.approx(want(units(t)), rel=1e-9) for i, t in enumerate(texts))


def units(text: str) -> str:
    """A character for each UTF-16 code unit."""
    data = text.encode("utf-16-le")
    return "".join(chr(int.from_bytes(data[i : i + 2], "little")) for i in range(0, len(data), 2))


def test_quality_tells_all_characters_apart(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["\U0001f600 a" * 4] * 40 + ["\U0001f600 a", "\U0001e600 a", "\x02\x02\x02a", "aaaa"])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.perplexity for r in quality.judge(docs, labels).collect()}
    assert found[40] < 0.5 * found[41]  # the two shared a code once
    assert len({round(x, 9) for x in (found[40], found[41], found[42], found[43])}) == 4


def test_quality_bounds_are_of_unseen_texts(spark, documents):
    """The models of the folds have not seen what they score, and few texts lean on the spread of all languages."""
    rng = random.Random(9)
    texts = {i: " ".join(rng.choice(["the", "and", "over", "river", "bank"]) for _ in range(30)) for i in range(120)}
    docs = spark.createDataFrame([(i, t, "en" if i < 115 else "xx") for i, t in texts.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int")
    folds = {i: zlib.crc32(str(i).encode()) % 4 + 1 for i in texts}
    rows = quality._plain(docs, "doc_id", "text", "lang")
    rows = rows.withColumn("fold", quality.fold_of(rows["doc_id"]))
    tables = quality.Tables(rows)
    for fold in (1, 4):
        want = plain_kneser_ney([units(t) for i, t in texts.items() if folds[i] != fold])
        found = {r.doc_id: r.perplexity for r in quality._scored(rows, tables, 10**9, fold).collect()}
        assert all(found[i] == pytest.approx(want(units(texts[i])), rel=1e-9) for i in range(0, 120, 11))
    ends = {r.lang: (r.low, r.high) for r in quality._bounds(rows, tables, 0.01, 0.99, 10**9).collect()}
    assert set(ends) == {"en", "xx"} and all(a < b for a, b in ends.values())
    assert all(r.accepted for r in quality.judge(docs.filter("doc_id >= 115"), labels, low=0.0, high=1.0).collect())
    unknown = quality.judge(docs.selectExpr("doc_id", "text", "'yy' AS lang"), labels.limit(0)).collect()
    assert all(r.accepted and r.low is None for r in unknown)


def test_quality_keeps_held_out_good_texts(spark, documents):
    """Trusted texts whose labels are not shown are mostly kept, in scarce languages too."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    good = {r.doc_id for r in labels.filter(out & (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).collect()}
    rows = [r for r in quality.judge(documents, labels.filter(~out)).collect() if r.doc_id in good]
    assert len(rows) > 5 and sum(r.accepted for r in rows) >= 0.8 * len(rows)

def test_quality_separates_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judge(documents, labels).join(labels, "doc_id").collect()
    good, bad = ([r.accepted for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) > 0.9 * len(good) and sum(bad) < 0.5 * len(bad)


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (5, 1, None), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(odd, labels).collect()
    assert len(rows) == 11
    assert all(not r.accepted and r.perplexity is None for r in rows if r.doc_id in (3, 4))
    none = quality.judge(odd, labels.limit(0)).collect()
    assert all(r.accepted == (r.perplexity is not None) for r in none)
    assert quality.judge(empty, labels).count() == 0
    for most in (quality.BROADCAST_ROWS, 0):
        kept = quality.keep_good(odd, labels, broadcast_rows=most)
        assert kept.columns == odd.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.accepted)


# op 4


PAGE = '<html><head><title>t</title></head><body><header>Site</header><nav>menu</nav>{0}<footer>foot</footer></body></html>'


def kept(page: str | None) -> list[tuple[str, int]]:
    found = htmltext.lines(page)
    return [(x[0], x[1]) for x, stays in zip(found, htmltext.kept_lines(found)) if stays]


def test_html_rules():
    page = PAGE.format('<div class="cookie-notice">ok?</div><article><header><h1>Head &amp; line</h1></header><p>One<b>two</b> &lt;x&gt;<br>three</p><form>f</form><script>var a="</p>";</script><ul><li>a<li>b</ul><section id="comments"><p>no</p></section></article><aside>side</aside>')
    assert kept(page) == [("Head & line", 1), ("Onetwo <x> three", 1), ("a", 1), ("b", 1)]
    assert kept(None) == kept("") == []
    assert kept("plain  text\n here") == [("plain text here", 0)]
    assert kept("<p>open <!-- never closed <p>x") == [("open", 0)]
    assert kept("<div title=it's>x</div><p a='b>c' d=\"e>f\">y") == [("x", 0), ("y", 0)]
    assert kept("1 < 2 <3 </ x> & <b>4</b>") == [("1 < 2 <3 & 4", 0)]


def test_html_keeps_article_text():
    """Names that only look like frames, embedded mathematics and fallbacks, and a story beside a teaser."""
    assert kept('<article><p class="share-price">Shares rose</p><div class="share-buttons">Like</div><p>by <math><mi>x</mi></math> and <object>fallback</object></p><xmp>raw <b></xmp></article>') == [("Shares rose", 1), ("by x and fallback", 1), ("raw <b>", 1)]
    story = "<div class='story'>" + "<p>a long paragraph of the story itself</p>" * 5 + "</div><article>teaser</article>"
    assert [t for t, _ in kept(story)] == ["a long paragraph of the story itself"] * 5 + ["teaser"]


@pytest.mark.parametrize("page", ["<a " * 300_000, "<b>" * 100_000 + "</i>" * 100_000, "<b>" * 50_000 + "<div></div><p></p>" * 50_000, "<svg>" * 200_000, "<!--" * 200_000, '<p a="' * 150_000, "<p a='x\" " * 100_000, "<li>" * 200_000, "<div>" * 150_000 + "x", "&" * 500_000, "<p>same</p>" * 60_000])
def test_html_is_linear(page):
    import time

    started = time.perf_counter()
    found = htmltext.lines(page)
    htmltext.signs(found)
    assert time.perf_counter() - started < 8


def test_html_whole_pages_are_brute_force():
    """What two pages share, by text and by shape, is one of the longest common subsequences of each."""
    rng = random.Random(8)

    def longest(a: list, b: list) -> int:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(60):
        pages = []
        for _ in range(2):
            menu = "".join(f"<li>{rng.choice('abc')}</li>" for _ in range(rng.randrange(4)))
            body = "".join(f"<p>{rng.choice(['one', 'two', 'three four five six'])}</p>" for _ in range(1 + rng.randrange(5)))
            pages.append(f"<div class=m><ul>{menu}</ul></div>" * rng.randrange(2) + f"<div class=story>{body} the story is the longest part of it</div>" + "<div class=f>foot</div>" * rng.randrange(2))
        (own, other) = (htmltext.signs(htmltext.lines(p), markup=False) for p in pages)
        texts = htmltext.common_lines(own[1], other[1])
        assert len(texts) == longest(own[1], other[1])
        runs, members = htmltext._runs(own[2])
        assert len(htmltext.common_lines(runs, htmltext._runs(other[2])[0])) == longest(runs, htmltext._runs(other[2])[0])
        assert texts <= htmltext.shared(own[1], own[2], [other[1:]]) <= texts | {i for m in members for i in m}


def test_html_common_lines_in_halves(monkeypatch):
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        whole = len(htmltext.common_lines(a, b))
        monkeypatch.setattr(htmltext, "CELLS", 4)
        found = sorted(htmltext.common_lines(a, b))
        monkeypatch.setattr(htmltext, "CELLS", 1 << 26)
        rest = iter(b)
        assert len(found) == whole and all(any(x == a[i] for x in rest) for i in found)


def test_html_shapes_are_differenced(spark):
    """Frames without telling names that say something else on each page go by their shape; copies do not hide the pages beside them."""
    page = lambda n: f"<div class=zz><ul>{''.join(f'<li>{n}{i}</li>' for i in range(3 + n % 2))}</ul></div><div class=body><p>story {n} goes on and on and on</p><p>and ends {n}</p></div><div class=yy>word {n}</div>"
    rows = [(n, f"https://a.example/{n}", page(n)) for n in range(4)] + [(10 + n, "https://a.example/2", page(2)) for n in range(3)] + [(20, "https://b.example/", page(7))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for markup in (True, False):
        texts = {r.page_id: r.text for r in htmltext.extract(pages, markup=markup).collect()}
        assert all(texts[n] == f"story {n} goes on and on and on and ends {n}" for n in range(4))
        assert texts[10] == texts[11] == texts[12] == texts[2] and texts[20].startswith("70 71")  # alone in its host


def test_html_common_lines_are_longest():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = sorted(htmltext.common_lines(a, b))
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(any(x == a[i] for x in rest) for i in found)


def test_html_differencing_and_odd_rows(spark):
    frame = lambda *body: "".join(f"<div>{x}</div>" for x in ("Welcome to us", *body, "All rights"))
    rows = [
        (1, "https://a.example/x/1", frame("first story")), (2, "https://a.example/x/2?q=1", frame("second story", "more")), (3, "https://b.example/x/1", frame("alone")),
        (4, "https://c.example/1", "<article><p>Same</p></article>"), (5, "https://c.example/2", "<article><p>Same</p></article>"), (6, None, None), (7, "not a url", ""), (7, "not a url", ""),
        (8, "https://d.example/1", frame("copy")), (9, "https://d.example/2", frame("copy")), (None, "https://e.example/", "<p>x</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (100_000, 0):
        found = htmltext.extract(pages.selectExpr("*", "1 AS key", "'h' AS host"), broadcast_rows=most).collect()
        texts = {r.page_id: r.text for r in found}
        assert len(found) == len(rows)
        assert texts[1] == "first story" and texts[2] == "second story more"
        assert texts[3] == "Welcome to us alone All rights"  # no neighbour in its host
        assert texts[4] == texts[5] == "Same" and texts[6] == texts[7] == "" and texts[None] == "x"
        assert texts[8] == texts[9] == "Welcome to us copy All rights"  # repeated whole: kept
        assert all(r.n_chars == len(r.text) for r in found)
    assert htmltext.extract(pages.limit(0)).count() == 0


# op 5


def test_sharding_is_even_and_keeps_groups(spark, documents):
    docs = documents.unionByName(documents.filter("doc_id < 30")).unionByName(documents.filter("doc_id = 7"))
    rows = sharding.shard(docs, shards=6).collect()
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    n = docs.count()
    assert sorted(map(len, by_shard.values()), reverse=True) == [n // 6 + (s < n % 6) for s in range(6)]
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    shards = defaultdict(set)
    for r in rows:
        if r.linked:
            shards[r.text_crc32, r.size].add(r.shard)
    assert len(shards) >= 25 and all(len(s) == 1 for s in shards.values())


def test_sharding_does_not_depend_on_partitions(spark, documents):
    docs = documents.unionByName(documents.filter("doc_id < 40").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars"))
    one, two = (Counter(map(tuple, sharding.digest(sharding.shard(d, shards=7)).collect())) for d in (docs, docs.repartition(5, "text")))
    assert one == two


def test_sharding_cuts_few_links(spark):
    """Brute force of what label propagation is for: links between equal texts are in one shard, at the law's even counts."""
    rng = random.Random(19)
    texts = [f"text {rng.randrange(60)}" for _ in range(240)] + [f"single {i}" for i in range(160)]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=8).collect()
    of = {r.doc_id: r.shard for r in rows}
    pairs = [(a, b) for a in range(240) for b in range(a) if texts[a] == texts[b]]
    assert sum(of[a] == of[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert sorted(Counter(of.values()).values()) == [50] * 8


def test_sharding_odd_rows(spark, odd, empty):
    rows = sharding.shard(odd).collect()
    assert len(rows) == 11 and sorted(r.shard for r in rows) == list(range(11)) and {r.slot for r in rows} == {0}
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(16, 0)}
    assert sharding.shard(empty).count() == 0
    one = odd.filter("doc_id = 1")
    many = one
    for _ in range(7):
        many = many.unionByName(many)
    counts = Counter(r.shard for r in sharding.shard(many, shards=5).collect())  # one group that no shard can hold
    assert sorted(counts.values()) == [25, 25, 26, 26, 26]


# op 6


def plain_contamination(text: str | None, items: list[tuple[int, str | None]], window: int = 10) -> tuple[int, set[int], set[int]]:
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, owners = split(text), set(), set()
    for item, own in ((i, split(t)) for i, t in items):
        k = min(window, len(own))
        if not k:
            continue
        grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                owners.add(item)
    return len(words), hit, owners


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_is_brute_force(spark, block_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdé")
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 6, 8])))) for i in range(12)]
    items += [(3, "a b a b a b"), (11, "b b b b")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(30)))) for i in range(40)] + [(40, None)]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4, block_bytes=block_bytes)
    for r, d in zip(sorted(found.collect()), sorted(decontaminate.digest(found).collect())):
        n, hit, owners = plain_contamination(dict(docs)[r.doc_id], items, 4)
        assert {w for s in r.spans for w in range(s.start, s.end)} == hit and set(r.items) == owners
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
        assert (d.n_words, d.n_hit, d.n_items, d.contaminated) == (n, len(hit), len(owners), bool(hit))
        assert d.items_sha256 == hashlib.sha256(",".join(sorted(map(str, owners))).encode()).hexdigest()


def test_decontamination_span_limit(spark):
    """Shorter runs than asked for stay, and count for nothing."""
    item = " ".join(f"i{n}" for n in range(30))
    docs = spark.createDataFrame([(1, " ".join(f"x{n}" for n in range(40)) + " " + " ".join(item.split()[:12])), (2, " ".join(f"y{n}" for n in range(60)) + " " + item)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, span_words=20).collect()}
    assert found[1].endswith("i11") and "i5" not in found[2]
    assert "i5" not in {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}[1]


def test_decontamination_cleans(spark, odd, empty, items):
    found = {r.doc_id: r for r in decontaminate.digest(decontaminate.contamination(odd, items)).collect()}
    assert found[1].contaminated and found[8].n_hit == 11 and found[6].n_items == 1 and not found[5].contaminated
    kept = decontaminate.decontaminate(odd, items)
    rows = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == odd.columns and 1 not in rows and 8 not in rows  # mostly benchmark
    assert rows[6].text == "Ein kurzer Satz mit" and rows[6].n_chars == 19
    assert rows[4].text is None and rows[4].n_chars is None and rows[9].text == " \n\t "
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(odd, items.limit(0)).count() == 11


# op 7


def test_chat_markers():
    assert chat.marker("User: hello") == (1, "hello")
    assert chat.marker("### Assistant: hi")[0] == 2 and chat.marker("<|system|>be kind")[0] == 0 and chat.marker("**Human:** x")[0] == 1
    assert chat.marker("The answer: 3") == (None, "The answer: 3") and chat.marker("plain") == (None, "plain")


def test_chat_recovers_and_is_one_viterbi(spark):
    talks = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = chat.format_chats(talks).collect()
    assert sum(r.role == r.known_role for r in rows) > 0.9 * len(rows)
    lined = chat.lines(talks)
    model = chat.train(lined)
    by_conv = defaultdict(list)
    for r in lined.collect():
        by_conv[r.conv_id].append(r)
    import numpy as np

    want = []
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r.turn, r.row, r.line))
        roles = chat._viterbi(model, np.array([r.begins for r in own]), np.array([r.mark for r in own]), np.array([r.symbol for r in own]), None, None)
        want += [(conv, r.turn, chat.ROLES[x]) for r, x in zip(own, roles) if r.line == 0]
    assert sorted(want) == sorted((r.conv_id, r.turn, r.role) for r in rows if r.part == 0)


def test_chat_pieces_agree(spark, monkeypatch):
    """One conversation over many pieces is decoded as in one."""
    rng = random.Random(4)
    rows = [(1, i, "user" if i % 2 else "assistant", "Hm" + "?" * rng.randrange(2) + " word" * rng.randrange(40)) for i in range(300)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.train(chat.lines(talk))
    whole = {r.turn: r.role for r in chat.recover(chat.lines(talk.coalesce(1)).withColumn("piece", __import__("pyspark").sql.functions.lit(0)), model).collect()}
    monkeypatch.setattr(chat, "PIECE_ROWS", 11)
    cut = chat.recover(chat.lines(talk), model).collect()
    assert {r.turn: r.role for r in cut} == whole and len(cut) == 300


def plain_roles(model, begins, mark, symbol):
    """The likeliest roles by trying all paths."""
    from itertools import product

    best = None
    for path in product(range(len(chat.ROLES)), repeat=len(begins)):
        score = model.start[path[0]]
        for i, role in enumerate(path):
            score += model.marks[role, mark[i]] + model.emit[role, symbol[i]]
            if i:
                score += (model.turn if begins[i] or mark[i] else model.stay)[path[i - 1], role]
        if best is None or score > best[0] + 1e-12:
            best = (score, path)
    return best


def test_chat_viterbi_is_brute_force(spark):
    rng = random.Random(14)
    rows = [(c, i, rng.choice(["user", "assistant", "system", None]), rng.choice(["User: hi?", "ok", "Bot: " + "w " * rng.randrange(30), "what?\nand so on", ""])) for c in range(25) for i in range(rng.randrange(1, 5))]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lined = chat.lines(talks)
    model = chat.train(lined)
    got = {(r.conv_id, r.turn, r.part): r for r in chat.recover(lined, model).collect()}
    by_conv = defaultdict(list)
    for r in sorted(lined.collect(), key=lambda r: (r.conv_id, r.turn, r.row, r.line)):
        by_conv[r.conv_id].append(r)
    for conv, own in by_conv.items():
        own = own[:8] if len(own) <= 8 else None
        if own is None:
            continue
        _, path = plain_roles(model, [r.begins for r in own], [r.mark for r in own], [r.symbol for r in own])
        firsts = {r.turn: chat.ROLES[p] for r, p in reversed(list(zip(own, path)))}
        assert all(got[conv, turn, 0].role == role for turn, role in firsts.items())


def test_chat_counts_do_not_depend_on_pieces(spark, monkeypatch):
    """Starts, orders and emissions are those of plain loops, whatever the pieces."""
    rng = random.Random(15)
    rows = [(None if c == 7 else c, i, rng.choice(["user", "assistant", "system", "alien"]), rng.choice(["x", "y\nz?", "long " * 20])) for c in range(20) for i in range(rng.randrange(1, 9))]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turn, start = [[1] * 3 for _ in range(3)], [1] * 3
    for conv in {c for c, *_ in rows}:
        last = None
        for k, (_, _, role, _) in enumerate(sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])):
            now = chat.role_index(role)
            if now is not None and k == 0:
                start[now] += 1
            elif now is not None and last is not None:
                turn[last][now] += 1
            last = now
    for piece_rows, parts in ((50_000, "1"), (3, "7"), (50_000, "16")):
        monkeypatch.setattr(chat, "PIECE_ROWS", piece_rows)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        model = chat.train(chat.lines(talks))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert [round(math.exp(x) * sum(start), 6) for x in model.start] == start
        assert [[round(math.exp(x) * sum(r), 6) for x in m] for m, r in zip(model.turn, turn)] == turn


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", "User: hi\nthere\nAssistant: hello"), (1, 1, None, None), (1, 1, "bot", ""), (None, None, "alien", "Q: why?"), (2, None, "human", "x")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS row", "2 AS piece")
    found = sorted(chat.format_chats(talk).collect(), key=str)
    first = [(r.part, r.role, r.rendered) for r in found if r.conv_id == 1 and r.turn == 0]
    assert first == [(0, "user", "<|user|>\nhi\nthere\n<|end|>"), (1, "assistant", "<|assistant|>\nhello\n<|end|>")]
    assert len(found) == 6 and chat.format_chats(talk.limit(0)).count() == 0


# op 8


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for kind, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
            ok = {"email": True, "ip": name != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_pii_base_is_the_patterns():
    rng = random.Random(6)
    pieces = ["a@b.c", "@", ".", "x.y@z-1.com.", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", " ", "-", "é", "999999999999999999999", "a@b", "%", "+44.20.7946.0958"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("block_terms", [200_000, 1])
def test_pii_finds_disclosing_terms(spark, block_terms):
    filler = "common words that stand everywhere among others "
    rows = [(i, f"{filler} {'Zephyrine' if i % 2 else 'Quorlax'} wrote from {'x@y.org' if i % 2 else '10.0.0.1'} number {i} alpha{chr(97 + i)}") for i in range(8)] + [(i, filler + "nothing here") for i in range(8, 40)] + [(50, "Zephyrine was seen"), (51, None), (52, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.personal_data(docs, block_terms=block_terms).collect()}
    named = {i: {r.text[s.start : s.end] for s in r.spans if s.kind == pii.TERM} for i, r in found.items()}
    assert named[1] == {"Zephyrine"} and named[0] == {"Quorlax"} and named[50] == {"Zephyrine"} and not named[20]
    clean = {r.doc_id: r.text for r in pii.sanitised(pii.personal_data(docs)).collect()}
    assert "x@y.org" not in clean[1] and "[EMAIL]" in clean[1] and "Zephyrine" not in clean[50] and clean[51] is None and clean[20] == found[20].text
    d = {r.doc_id: r for r in pii.digest(pii.personal_data(docs)).collect()}
    base = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in plain_spans(found[1].text))
    assert d[1].n_email == 1 and d[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and "term:" in d[1].spans
    assert d[51].spans == d[52].spans == "" and d[51].n_phone == 0


def _planted_secrets() -> dict[int, str]:
    rng, words = random.Random(11), [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    texts = {}
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if i % 10 == 0:
            value = "".join(rng.choices("0123456789abcdef", k=40)) if i % 50 else "-".join(rng.choices(words, k=2))
            w.insert(rng.randrange(len(w)), f'passkey = "{value}"')
        elif i % 10 == 1:
            w.insert(rng.randrange(len(w)), f"mailto a{i}@b.example")
        texts[i] = " ".join(w)
    return texts


def test_pii_finds_planted_secrets(spark):
    """Random identifiers, and what is assigned to a word that leads to them even if it looks like words."""
    texts = _planted_secrets()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    secret = {i: [r.text[s.start : s.end] for s in r.spans if s.kind == pii.SECRET] for i, r in found.items()}
    assert all(bool(secret[i]) == (i % 10 == 0) for i in texts)
    assert all(len(secret[i]) == 1 and f'"{secret[i][0]}"' in texts[i] for i in texts if i % 10 == 0)
    assert {r.text[s.start : s.end] for r in found.values() for s in r.spans if s.kind == pii.TERM} == {"passkey", "mailto"}
    assert not any(r.spans for i, r in found.items() if i % 10 > 1)


def test_pii_disclosure_is_brute_force(spark):
    """Shares of entities and classes from plain counts over a random corpus with copies."""
    rng = random.Random(12)
    texts = []
    for _ in range(300):
        w = [rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "rare" + "xyz"[rng.randrange(3)]]) for _ in range(rng.randrange(1, 25))]
        for _ in range(rng.randrange(3)):
            kind = rng.randrange(3)
            w.insert(rng.randrange(len(w) + 1), ["lead" + "pqr"[kind], ""][rng.randrange(4) == 0] + " " + [f"u{rng.randrange(4)}@x.org", f"10.0.0.{rng.randrange(9)}", "".join(rng.choices("0123456789abcdef", k=32))][kind])
        texts.append(" ".join(w))
    texts += texts[:40]
    n_t, n_e, n_k, both, values = Counter(), Counter(), Counter(), defaultdict(Counter), defaultdict(set)
    sources, in_class = defaultdict(set), Counter()
    for t in texts:
        beside = {k: {x.decode() for x in v} for k, v in pii._beside(t).items()}
        n_t.update({x.decode() for x in pii._terms(t)})
        n_e.update(beside.keys())
        n_k.update({k for k, _ in beside})
        in_class.update({(x, k) for (k, _), terms in beside.items() for x in terms})
        for (k, e), terms in beside.items():
            for x in terms:
                both[x][k, e] += 1
                sources[x, k, e].add(t)
                values[x, k].add(e)
    share = lambda n_both, n_one, n_term: math.log2(n_both * len(texts) / (n_term * n_one)) / -math.log2(n_one / len(texts))
    want = defaultdict(lambda: [0.0, False])
    for x, pairs in both.items():
        for (k, e), n in pairs.items():
            if len(sources[x, k, e]) >= 3 and (v := share(n, n_e[k, e], n_t[x])) >= 0.3:
                want[x][0] = max(want[x][0], v)
        for k in n_k:
            if len(values[x, k]) >= 5 and (v := share(in_class[x, k], n_k[k], n_t[x])) >= 0.3:
                want[x] = [max(want[x][0], v), want[x][1] or k == pii.SECRET]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r.term: (r.disclosure, r.leads) for r in pii.disclosing_terms(docs, generalise=0.3).collect()}
    assert found.keys() == want.keys() and len(found) >= 2
    assert all(found[x][0] == pytest.approx(want[x][0]) and found[x][1] == want[x][1] for x in want)


def test_pii_odd_rows(odd, empty):
    assert pii.digest(pii.personal_data(odd)).count() == 11 and pii.personal_data(empty).count() == 0


# op 9


def test_jpeg_round_trip():
    rng = random.Random(7)
    payloads = [jpeg.padded(b""), bytes(rng.randrange(256) for _ in range(640)), jpeg.padded(b"\xff\x00" * 300), jpeg.padded(bytes([0, 255]) * 40), bytes(64) * 8300]
    for payload, blob, images in zip(payloads, jpeg.encode(payloads), jpeg.decode(jpeg.encode(payloads))):
        assert b"".join(x["thumbnail"].tobytes() for x in images) == payload
        assert blob[:2] == b"\xff\xd8" and blob[-2:] == b"\xff\xd9" and len(images) == -(-len(payload) // (64 * 8191))
    assert jpeg.encode([]) == [] and jpeg.decode([]) == []


def _image(width: int, height: int, parts: list[tuple[int, int, int]], blocks: list[tuple[int, list[tuple[int, int]]]], restart: int = 0, per: int = 1) -> bytes:
    """A baseline JPEG from (component, [(symbol or DC value, ...)]) blocks in scan order, with AC coefficients."""
    dc = {c: code for c, code in zip(range(12), range(12))}  # 4-bit codes
    ac = {0x00: 0, 0x01: 1, 0x11: 2, 0xF0: 3, 0x02: 4}  # 3-bit codes
    bits, out, held, n = "", b"", defaultdict(int), 0

    def number(v: int) -> tuple[int, str]:
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def flush() -> bytes:
        padded = bits + "1" * (-len(bits) % 8)
        return bytes(int(padded[i : i + 8], 2) for i in range(0, len(padded), 8)).replace(b"\xff", b"\xff\x00")

    for component, (value, runs) in blocks:
        if restart and n and n % (restart * per) == 0:
            out += flush() + bytes([0xFF, 0xD0 + (n // (restart * per) - 1) % 8])
            bits, held = "", defaultdict(int)
        size, extra = number(value - held[component])
        held[component] = value
        bits += format(dc[size], "04b") + extra
        for run, level in runs:
            size, extra = number(level)
            bits += format(ac[run << 4 | size], "03b") + extra
        bits += "000"
        n += 1
    out += flush()
    seg = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in parts)
    scan = bytes([len(parts)]) + b"".join(bytes([i, 0]) for i, _, _ in parts) + b"\0\x3f\0"
    return (b"\xff\xd8" + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, frame) + seg(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + seg(0xC4, b"\x10" + bytes([0, 0, 5] + [0] * 13) + bytes(ac))
            + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, scan) + out + b"\xff\xd9")


@pytest.mark.parametrize("restart", [0, 1, 2])
def test_jpeg_reads_other_layouts(restart):
    """Two components, the first sampled 2x1, with AC coefficients, with and without restarts."""
    rng = random.Random(restart)
    grid = [[rng.randrange(-100, 100) for _ in range(4)] for _ in range(3)]
    blocks = []
    for row in grid:
        for x in (0, 2):
            blocks += [(1, (row[x], [(1, 1), (15, 0), (0, -3)])), (1, (row[x + 1], [])), (2, (rng.randrange(-50, 50), [(0, 1)]))]
    (image,) = jpeg.decode([_image(32, 24, [(1, 2, 1), (2, 1, 1)], blocks, restart, 3)])[0]
    assert (image["width"], image["height"]) == (32, 24) and (image["thumbnail"].astype(int) - 128).tolist() == grid


def test_jpeg_rejects_others():
    for blob in (b"GIF89a", b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00", b"\xff\xd8\xff\xd9"):
        with pytest.raises(jpeg.NotBaseline):
            jpeg.decode([blob])


def test_media_of_long_texts_go_image_by_image():
    rng = random.Random(16)
    text = bytes(rng.randrange(256) for _ in range(2 * 64 * jpeg.ROWS + 100))
    payload = jpeg.padded(text)
    whole = jpeg.encode([payload])[0]
    assert b"".join(jpeg._stored_form(payload)) == whole and jpeg._encoded([b"a", text, b""])[1] == whole
    (row,) = jpeg._read([whole])
    assert row[:5] == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(whole), hashlib.sha256(whole).hexdigest())
    assert row[5] == jpeg.features(jpeg.decode([whole])[0]) and jpeg._features_of([text]) == [row]


def test_media_that_are_broken_are_null(spark):
    good = jpeg.encode([jpeg.padded(b"hello")])[0]
    media = spark.createDataFrame([(1, 5, good), (2, 5, None), (3, 5, b""), (4, 5, b"GIF89a"), (5, 5, good[:-30]), (6, 5, good)], "doc_id long, n_bytes long, media binary")
    found = {r.doc_id: r for r in jpeg.read_media(media).collect()}
    assert found[1].payload_bytes == found[6].payload_bytes == 64 and all(found[i].payload_bytes is None and found[i].feature is None for i in (2, 3, 4, 5))


def test_media_columns(spark, odd, empty):
    one = {r.doc_id: r for r in jpeg.media_features(odd).collect()}
    two = {r.doc_id: r for r in jpeg.read_media(jpeg.as_media(odd)).collect()}
    assert one == two and jpeg.media_features(odd).count() == 11 and jpeg.media_features(empty).count() == 0
    for r in odd.collect():
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (one[r.doc_id].n_bytes, one[r.doc_id].payload_bytes) == (len(data), len(payload))
        assert one[r.doc_id].payload_sha256 == hashlib.sha256(payload).hexdigest() and one[r.doc_id].tail_crc32 == zlib.crc32(payload[-64:])


# op 10


def plain_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(3.0 * sizes[s] for s in full)
        total = sum(w for s, w in weight.items() if s not in full)
        share = {s: left * weight[s] / total for s in names if s not in full}
        above = {s for s, x in share.items() if x > 3.0 * sizes[s]}
        if not above:
            return share | {s: 3.0 * sizes[s] for s in full}
        full |= above


def test_mixing_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * (1 + rng.randrange(3)) for _ in range(rng.randrange(1, 60))), rng.choice(["b", "a", "é", "Z", None] + ["hot"] * 6)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixture(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    source = {i: s for i, _, s in rows}
    for r in found:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.size * r.copies
        target[source[r.doc_id]] = r.target
        assert r.copies <= 3
    want = plain_targets(sizes)
    most = {s: max(r.size for r in found if source[r.doc_id] == s) for s in want}
    assert all(target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 3 * most[s] + 0.03 * sizes[s] for s in want)
    assert sorted(found) == sorted(mixing.mixture(docs.repartition(3)).collect())
    out = mixing.mix(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in found if r.copies})


def test_mixing_comes_near_its_targets(spark):
    """Texts of very unlike sizes: a source departs by no more than its largest text and what the small ones add by chance."""
    rng = random.Random(18)
    rows = [(i, "w " * int(2 + 4000 * rng.random() ** 12), rng.choice(["a", "b", "c"] + ["hot"] * 6)) for i in range(2500)]
    rows += rows[:50]  # repeated rows
    found = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source, taken, target, largest = {i: s for i, _, s in rows}, Counter(), {}, Counter()
    for r in found:
        s = source[r.doc_id]
        taken[s] += r.size * r.copies
        target[s], largest[s] = r.target, max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] + 0.01 * target[s] for s in target)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == sum((Counter({r.doc_id: r.copies}) for r in found), Counter())


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mixture(odd).collect()
    assert len(rows) == 11 and all(r.size == 0 and r.copies <= 3 for r in rows if r.doc_id in (3, 4, 9))
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mixture(empty).count() == 0 and mixing.mix(empty).count() == 0


def rendered(rows) -> dict:
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn, r.part)):
        body = r.rendered.removeprefix(f"<|{r.role}|>\n").removesuffix("\n<|end|>")
        out[r.conv_id, r.turn].append((r.role, body))
    return out


def test_chat_loses_no_text(spark):
    """Code, options, answers and quotes that look like markers, in conversations that have none."""
    talk = [
        (1, 0, "user", "Pick one:\nA: Paris\nB: Rome"), (1, 1, "assistant", "def f():\n    return 1\n\nprint(f())"), (1, 2, "user", "Support: call 911"), (1, 3, "assistant", "Answer: 42\nModel: T5"),
        (2, 0, "user", "You > me"), (2, 1, "assistant", "a - b"), (2, 2, "user", "Me: x"), (2, 3, "assistant", "  indented\r\n\n\ttab\x85next sep\x1c end \n"),
        (3, 0, "user", "Q: one?\nA: 1\nQ: two?"), (3, 1, "assistant", "2"),
    ]
    found = rendered(chat.format_chats(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect())
    for conv, turn, _, text in talk:
        assert len(found[conv, turn]) == 1 and found[conv, turn][0][1] == text, (conv, turn, found[conv, turn])


@pytest.mark.parametrize("form", ["<|im_start|>{0}\n{1}", "### {0}\n{1}", "**{0}:** {1}", "[{0}] {1}", "{0}: {1}", "{0}\n{1}", "## {0}: {1}"])
def test_chat_markers_in_every_form(spark, form):
    """Transcripts in one row each: markers go, roles are found, other lines stay."""
    lines_ = [("User", "how are you?"), ("Assistant", "well:\n\n  - Note: a list\n  - b"), ("User", "and now?"), ("Assistant", "still well")]
    merged = "\n".join(form.format(name, text) for name, text in lines_)
    found = rendered(chat.format_chats(spark.createDataFrame([(1, 0, None, merged)], "conv_id long, turn long, role string, text string")).collect())
    assert found[1, 0] == [("user", "how are you?"), ("assistant", "well:\n\n  - Note: a list\n  - b"), ("user", "and now?"), ("assistant", "still well")]


def test_chat_roles_of_held_out_conversations(spark):
    """Roles of conversations that taught nothing, from features alone."""
    from pyspark.sql import functions as F

    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").withColumn("held", F.crc32(F.col("conv_id").cast("string")) % 5 == 0)
    lined = chat.lines(talks.withColumn("role", F.when(~F.col("held"), F.col("role"))))
    found = chat.recover(lined, chat.train(lined)).filter("part = 0").join(talks.filter("held").select("conv_id", "turn", F.col("role").alias("true")).distinct(), ["conv_id", "turn"]).collect()
    known = [r for r in found if chat.role_index(r.true) is not None]
    assert sum(chat.ROLES[chat.role_index(r.true)] == r.role for r in known) > 0.95 * len(known)
