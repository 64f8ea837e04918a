"""Each text operator against a plain version of its contract, on the small samples and on odd rows."""

import collections
import hashlib
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from planloom.llm import common, decontaminate, html_text, langid, licenses, line_dedup, mixing, quality, queries, resharding, simhash, token_output

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row string, source_ string, fp string"
LONG = " ".join(f"word{i % 977} Foo," for i in range(20_000))
ODD = [
    (1, None, None, None, None, "x", "y", "z", "w"),
    (2, "", "en", "a", 0, None, None, None, None),
    (3, "   \n\t ", "en", "a", 3, "x", "y", "z", "w"),
    (4, LONG, "en", "a", len(LONG), "x", "y", "z", "w"),
    (5, LONG, "en", "b", len(LONG), "x", "y", "z", "w"),
    (5, LONG, "en", "b", len(LONG), "x", "y", "z", "w"),
    (None, "no id here, only words", "fr", "b", 5, "x", "y", "z", "w"),
    (6, "É été\nThe SAME line stands here!\nthe same line stands here!  ", "fr", "b", 5, "x", "y", "z", "w"),
    (7, "The same line stands here!\nLicensed under the Apache License, Version 2.0.", "de", None, 5, "x", "y", "z", "w"),
    (8, "the same line stands here!", "de", None, 5, "x", "y", "z", "w"),
    (9, "12345 !!! ---", "de", "c", 5, "x", "y", "z", "w"),
    (10, "\u0001\u001c odd   spaces\u0085 and 😀 <|endoftext|> Σίσυφος İ", "es", "c", 5, "x", "y", "z", "w"),
]
has_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no sample tables")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def sample(spark, name="documents"):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def both(spark, odd):
    """The sample's documents and the odd rows, as one frame with their texts."""
    out = odd.select("doc_id", "text", "lang", "source", "n_chars")
    return out.unionByName(sample(spark).withColumn("doc_id", F.col("doc_id") + 100)) if Path(DATA).exists() else out


def words_ws(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# -- 1 ---------------------------------------------------------------------------------------------


def test_licenses(spark):
    model = licenses.fit()
    rows = [
        (1, "some prose of the day\nLicensed under the Apache License, Version 2.0.\nmore prose"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "Released under the MIT License."),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "She lost her driving license and had to apply for a new one."),
        (6, "nothing of the kind"),
        (7, None),
        (8, "RELEASED UNDER THE MIT LICENSE\nLicensed under the Apache License, Version 2.0."),
        (9, "This text may be shared under the Frobnicator Community Licence of the guild of bakers, see the copyright office."),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert [got[i].license for i in range(1, 8)] == ["Apache-2.0", "GPL", "MIT", "CC-BY-NC", "none", "none", "none"]
    assert got[8].families == "Apache-2.0,MIT" and got[8].n_license == 2 and got[8].n_paragraphs == 2
    assert got[9].license in ("unknown", "none") and all(0 <= r.probability <= 1 for r in got.values())


def test_license_families_recognised():
    model = licenses.fit()
    assert licenses.fit() == model

    def predict(text):
        grams = [g for g in licenses.ngrams(licenses.words(text)) if g in model.weights]
        scale = len(grams) ** -0.5 if grams else 0.0
        z = [b + scale * sum(model.weights[g][c] for g in grams) for c, b in enumerate(model.bias)]
        return model.classes[z.index(max(z))]

    right = [predict(t) == f for f, ts in licenses.TEMPLATES.items() for t in ts]
    assert sum(right) >= 0.9 * len(right)
    assert all(predict(t) == licenses.NONE for t in licenses.OTHER if not any(a in t.lower() for a in licenses.ANCHORS))


@has_data
def test_licenses_on_the_sample(spark, odd):
    docs = both(spark, odd)
    known = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    want = collections.Counter((i, ",".join(sorted({f for line, f in known.items() if line in (t or "").split("\n")}))) for i, t in texts(docs))
    got = collections.Counter((r.doc_id, r.families) for r in licenses.scan(docs).collect())
    assert got == want


# -- 2 ---------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{a}</style><script>var x="</p><p>no</p>";</script></head>
<body><header><h1>Site</h1><nav><ul><li><a href="/a">Menu one</a><li><a href='/b'>Two</a></ul></nav></header>
<div class="cookie-notice">We use cookies on this site and the visitors have to agree with it.</div>
<article><h1>Short&nbsp;head</h1><p>The first of the   paragraphs has <b>bold</b> and <a href="#">a link</a> in it &lt;here&gt;, and it is long enough for a decision.
<p>Second&#33; It&#x27;s not closed.<br>Same block<br><br>next block<ul><li>item one<li>item two</ul>
<form><input value="x">Send me mail <button>Go</button></form><aside>Related things of the day</aside>
<!-- hidden <p>comment</p> --><div id="comments"><p>First! The best of the posts that I have read on the site in a year.</p></div></article>
<footer>&copy; us</footer></body></html>"""


def test_html_page():
    assert html_text.main_text(PAGE).split("\n") == [
        "Short head", "The first of the paragraphs has bold and a link in it <here>, and it is long enough for a decision.", "Second! It's not closed. Same block", "next block", "item one", "item two",
    ]


def test_html_without_article():
    page = """<body><div class="menu"><a href="/">Home</a></div><div><a href="/1">One link of the list</a> <a href="/2">Another link of the list</a></div>
    <h2>Title</h2><div>The main text of this page is a long paragraph with the words that are in all of the texts, and so it is kept.</div>
    <div>Short.</div><div>It is followed by one more of the same kind, with a lot of the small words that we look for in it.</div>
    <div>xkcd qwerty asdf zxcv uiop hjkl vbnm qwertz yxcv poiu lkjh mnbv rewq fdsa vcxy trewq gfdsa bvcxy hgfd</div></body>"""
    got = html_text.main_text(page)
    assert got.startswith("Title\nThe main text") and "Short." in got and "xkcd" not in got and "Home" not in got and "link of" not in got


def test_html_class_names_that_mislead():
    text = "The main text of this page is a long paragraph with the words that are in all of the texts, and so it is kept."
    assert html_text.main_text(f'<body><div class="page with-sidebar no-comments"><p>{text}</p><div class="sidebar"><p>Side</p></div></div></body>') == text
    head = '<div class="site-header"><p>The name of the site and the words that are on top of all of its pages, every one of them.</p></div>'
    assert html_text.main_text(f'<body>{head}<div class="post-header"><h1>Title</h1></div><div class="post-body"><p>{text}</p></div><div class="contact-form">Write to us</div></body>') == f"Title\n{text}"
    assert html_text.main_text(f'<body><div id="widget"><p>{text}</p></div><footer>us</footer></body>') == text


@pytest.mark.parametrize("page", ["", "<", "<p", "<a href='x", "<!-- never closed <p>x", "<script>never closed", "</p></div>", "<p>" * 3000 + "x", "a < b && c > d", "<div " * 2000, "&#xD800; &#1114112; &bogus; &amp"])
def test_html_never_fails(page):
    assert isinstance(html_text.main_text(page), str)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "v", "", "t"), (3, "v", "", "t"), (None, "w", "<article>é 😀</article>", "t")], "page_id bigint, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == 5 and {(r.page_id, r.n_chars) for r in got} == {(1, len(html_text.main_text(PAGE))), (2, 0), (3, 0), (None, 3)}
    assert html_text.extract(pages.limit(0)).count() == 0


@has_data
def test_html_on_the_sample(spark):
    def article(page):
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        import html as h

        parts = [" ".join(h.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        return "\n".join(x for x in parts if x)

    rows = sample(spark, "pages").collect()
    got = {r.page_id: r.text for r in html_text.extract(sample(spark, "pages")).collect()}
    assert sum(got[r.page_id] == article(r.html) for r in rows) >= 0.95 * len(rows)


# -- 3 ---------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = words_ws(ascii_lower(text))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    """(doc, fingerprint) pairs to the smallest doc reachable, comparing all distinct fingerprints."""
    prints = sorted({f for _, f in pairs})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(b)] = find(a)
    low = {}
    for d, f in pairs:
        low[find(f)] = min([x for x in (low.get(find(f)), d) if x is not None], default=None)
    return {f: low[find(f)] for f in prints}


def test_simhash(spark, odd):
    docs = both(spark, odd)
    want = [(d, plain_fingerprint(t)) for d, t in texts(docs)]
    names = plain_components(want)
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == collections.Counter((d, f"{f:016x}", names[f]) for d, f in want)


@pytest.mark.parametrize("spread", [6, 14, 20])
def test_simhash_links_of_dense_clouds(spark, spread, monkeypatch):
    """Many fingerprints around a few centres: small, searched and indexed-again buckets lose no link."""
    monkeypatch.setattr(simhash, "REINDEXED", 40)
    rng = np.random.default_rng(spread)
    prints = set()
    for centre in rng.integers(0, 2**63, 3, dtype=np.uint64):
        weak = rng.choice(64, spread, replace=False)
        for _ in range(250):
            flips = weak[rng.random(spread) < 0.25]
            prints.add(int(centre) ^ int(sum(1 << int(b) for b in flips)))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))).collect()}
    groups = collections.defaultdict(set)
    for x in signed:
        groups[roots.get(x, x)].add(x % (1 << 64))
    want = plain_components([(x, x) for x in prints])
    wanted = collections.defaultdict(set)
    for x in prints:
        wanted[want[x]].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_reindexed_buckets_keep_all_links():
    rng = np.random.default_rng(3)
    base = np.uint64(0x0123456789ABCDEF)
    low = rng.integers(0, 1 << 14, 5000).astype(np.uint64)
    values = np.unique((base & ~np.uint64(0x3FFF)) | low)
    keys = np.full(len(values), 40 << 32 | 5, np.int64)  # shares the upper segment
    a, b = simhash._forest(simhash._links(keys, values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    label = np.arange(len(values))
    while not np.array_equal(label, least := np.where(near, label[None, :], len(values)).min(axis=1)):
        label = least
    child = np.flatnonzero(label != np.arange(len(values)))
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist())} == {(int(values[label[i]]), int(values[i])) for i in child}
    whole = simhash._forest(simhash._search(values))
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist())} == {(x, y) for x, y in zip(whole[0].tolist(), whole[1].tolist())}


def test_chain_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 103), (102, 103)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100, 103: 100}


def test_keep_one(spark, odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, None, 6, 7, 8, 9, 10], key=str)
    assert simhash.keep_one(empty).count() == simhash.near_duplicates(empty).count() == 0


# -- 4 ---------------------------------------------------------------------------------------------


def test_tokens(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    docs = both(spark, odd)
    rows = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = [tuple(r) for r in token_output.encode_and_read_back(docs, queries.tokenizer_path()).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_workers_let_go_of_the_encoder(spark):
    """A worker that has encoded holds an encoder until another operator's task runs there."""

    def held(batches):
        import gc

        for batch in batches:
            yield batch.set_column(0, "n", pa.array([sum(type(x).__name__ == "Encoder" for x in gc.get_objects())] * batch.num_rows, pa.int64()))

    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(16)], "doc_id bigint, text string").repartition(4)
    assert token_output.tokenize(docs, queries.tokenizer_path()).count() == 16
    counts = [r.n for r in common.map_batches(spark.range(0, 64, 1, 16), held, "n bigint").collect()]
    assert len(counts) == 64 and not any(counts)
    again = token_output.tokenize(docs, queries.tokenizer_path()).collect()
    assert sorted(r.doc_id for r in again) == [*range(16)] and all(r.tokens[-1] == token_output.END_ID for r in again)


def test_token_files(spark, odd, empty, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    token_output.write_tokens(both(spark, odd), path, queries.tokenizer_path())
    files = sorted(Path(path).glob("*.parquet"))
    ids = [i for f in files for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    meta = pq.ParquetFile(files[-1]).metadata.row_group(0)
    assert all(meta.column(c).has_column_index and meta.column(c).has_offset_index for c in range(meta.num_columns))
    plan = token_output.read_tokens(spark, path).select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<n_tokens:int>" in plan
    assert token_output.encode_and_read_back(empty, queries.tokenizer_path()).count() == 0


# -- 5 ---------------------------------------------------------------------------------------------


def plain_contamination(text, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(word, ascii_lower(text))
    hit, found = set(), set()
    for item, other in items:
        o = re.findall(word, ascii_lower(other))
        n = min(10, len(o))
        if not n:
            continue
        grams = {tuple(o[k : k + n]) for k in range(len(o) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


ITEMS = [(1, "the same line stands"), (2, None), (3, "--"), (10, "Word0 foo word1 foo word2 foo word3 foo word4 foo word5 foo"), (None, "no id here"), (4, "the same line stands"), (5, "ÉTÉ")]


@pytest.mark.parametrize("sets", [{}, {"listed_windows": 0}, {"listed_windows": 0, "broadcast_hashes": 700}])
def test_decontamination(spark, odd, sets, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 64)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    if Path(DATA).exists():
        items = items.unionByName(sample(spark, "benchmark").withColumn("item_id", F.col("item_id") + 100))
    docs = both(spark, odd).withColumn("items", F.lit("x")).withColumn("words", F.lit(1))
    known = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
    got = decontaminate.contamination(docs, items, **sets)
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect() if r.doc_id is not None)
    assert got == collections.Counter((d, *plain_contamination(t, known)) for d, t in texts(docs) if d is not None)


def test_decontamination_of_nothing(spark, odd, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(odd, none).collect())
    assert decontaminate.contamination(empty, none).count() == 0


def test_removal(spark, odd):
    items = spark.createDataFrame(ITEMS[:1], "item_id bigint, text string")
    left = decontaminate.remove_contaminated(odd, items)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 5, 9, 10]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(odd, items).collect()}
    assert cut[8] == "here!" and cut[7] == "here! Licensed under the Apache License, Version 2.0." and cut[4] == LONG and cut[1] is None


# -- 6 ---------------------------------------------------------------------------------------------


def test_line_dedup(spark, odd):
    docs = both(spark, odd)
    rows = texts(docs)
    blank = " \t\n\x0b\x0c\r"
    keys = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = ascii_lower(line.strip(blank))
            if len(key) >= 20 and d is not None:
                keys[key].add(d)
    want = collections.Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not (len(k := keys.get(ascii_lower(x.strip(blank)), ())) >= 3 and d < max(k))]
        want[(d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    got = line_dedup.dedup_lines(docs).collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_line_dedup_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------


def test_mixing_meets_its_limits(spark):
    rng = np.random.default_rng(1)
    sizes = {"hot": 6000, "a": 900, "b": 300, None: 1500}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * int(rng.integers(1, 40))), s))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.plan(docs, max_passes=3.0).collect()
    assert len(got) == len(rows) and min(r.copies for r in got) >= 1 and max(r.copies for r in got) <= 3
    tokens, taken, weight, passes = collections.Counter(), collections.Counter(), {}, {}
    for r in got:
        tokens[r.source] += r.n_tokens
        taken[r.source] += r.n_tokens * r.copies
        weight[r.source], passes[r.source] = r.weight, r.passes
    assert sum(weight.values()) == pytest.approx(1) and max(passes.values()) == pytest.approx(3.0, abs=1e-4) and passes["hot"] == pytest.approx(1)
    for s in tokens:
        assert taken[s] == pytest.approx(passes[s] * tokens[s], rel=0.03)
        assert taken[s] / sum(taken.values()) == pytest.approx(weight[s], rel=0.03)
    assert all(len(r.positions) == r.copies and 0 <= min(r.positions) <= max(r.positions) < 1.01 for r in got)
    for k in range(4):  # each quarter of the mix holds the sources at their weights
        part = collections.Counter()
        for r in got:
            part[r.source] += r.n_tokens * sum(k / 4 <= p < (k + 1) / 4 for p in r.positions)
        assert all(part[s] / sum(part.values()) == pytest.approx(weight[s], rel=0.1) for s in weight)
    placed = [(p, r.doc_id) for r in got for p in r.positions]
    assert [r.doc_id for r in mixing.mix(docs, max_passes=3.0, in_order=True).collect()] == [d for _, d in sorted(placed)]
    mixed = mixing.mix(docs.withColumn("block", F.lit("z")), max_passes=3.0)
    assert mixed.columns == ["doc_id", "text", "source", "block"]
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({r.doc_id: r.copies for r in got})


def test_mixing_with_budget_and_entropy(spark):
    from math import log

    docs = spark.createDataFrame([(i, "w " * 10, "hot" if i % 4 else "small") for i in range(4000)], "doc_id bigint, text string, source string")
    got = mixing.plan(docs, budget=20_000, entropy=0.95, max_passes=1e9).collect()
    weights = {r.source: r.weight for r in got}
    assert -sum(w * log(w) for w in weights.values()) / log(2) == pytest.approx(0.95, abs=1e-3)
    assert sum(r.n_tokens * r.copies for r in got) == pytest.approx(20_000, rel=0.03)


def test_mixing_odd_rows(odd, empty):
    assert mixing.plan(odd).count() == len(ODD) and mixing.mix(odd).count() >= len(ODD) and mixing.mix(odd).columns == odd.columns
    assert mixing.plan(empty).count() == mixing.mix(empty).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------


def brute_cost(supply, demand):
    """Least moved amount: what cannot stay."""
    return sum(max(0, s - (demand[i] if i < len(demand) else 0)) for i, s in enumerate(supply))


@pytest.mark.parametrize("seed", range(6))
def test_flow_moves_the_least(seed):
    rng = np.random.default_rng(seed)
    supply = [int(x) for x in rng.integers(0, 1000, int(rng.integers(1, 9)))]
    n = int(rng.integers(1, 9))
    demand = resharding.equal_capacities(sum(supply), n)
    flow = resharding.min_cost_flow(supply, demand)
    assert [sum(x for (a, _), x in flow.items() if a == i) for i in range(len(supply))] == supply
    assert all(sum(x for (_, b), x in flow.items() if b == j) <= demand[j] for j in range(n)) and all(x > 0 for x in flow.values())
    assert sum(x for (a, b), x in flow.items() if a != b) == brute_cost(supply, demand)


def test_flow_with_other_costs_and_too_little_room():
    flow = resharding.min_cost_flow([5, 5], [5, 5], lambda i, j: [[3, 1], [1, 9]][i][j])
    assert flow == {(0, 1): 5, (1, 0): 5}
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [4])


def check_layout(rows, docs, shards):
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


@has_data
@pytest.mark.parametrize("block_rows", [50_000, 1])
def test_resharding(spark, odd, block_rows):
    docs = sample(spark).unionByName(sample(spark).withColumn("doc_id", F.col("doc_id") + 1000)).withColumn("shard", F.lit("x"))
    rows = resharding.reshard(docs, shards=4, block_rows=block_rows).collect()
    check_layout(rows, texts(docs), 4)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 4


def test_resharding_odd_rows(odd, empty):
    rows = resharding.reshard(odd).collect()
    check_layout(rows, texts(odd), 16)
    assert resharding.reshard(empty).count() == 0


def test_rewriting_touches_only_what_changes(spark, tmp_path):
    docs = spark.createDataFrame([(i // 2, "x" * 9, 0 if i < 100 else 1 if i < 160 else 2) for i in range(200)], "doc_id bigint, text string, old int")
    assert resharding.rewrite(docs, str(tmp_path / "n"), 3, "old", capacities=[600, 600, 800]) == [0, 2]
    back = spark.read.parquet(str(tmp_path / "n"))
    assert collections.Counter(r.shard for r in back.collect()) == {0: 60, 2: 80} and back.select("row.*").columns == docs.columns
    assert resharding.rewrite(docs, str(tmp_path / "m"), 3, "old", capacities=[600, 600, 800], all_shards=True) == [0, 1, 2] and spark.read.parquet(str(tmp_path / "m")).count() == 200


@has_data
@pytest.mark.parametrize("shards, old", [(16, 12), (4, 4), (5, 9), (1, 3)])
def test_layout_moves_the_least(spark, odd, shards, old):
    """Bytes moved by the layout against what cannot stay, and the shards' sizes against equal ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", (F.pow(F.rand(5), 2) * old).cast("int").alias("old")).unionByName(odd.where("text IS NULL OR length(text) < 1000").select("doc_id", "text", F.lit(0).alias("old")))
    docs = common.materialize(docs, "old")
    rows = resharding.reshard(docs, shards=shards, old_shard="old").collect()
    check_layout(rows, texts(docs), shards)
    sizes, supply = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.shard] += r.size
        supply[r.old_shard] += r.size
    total = sum(sizes.values())
    least = brute_cost([supply[i] for i in range(old)], resharding.equal_capacities(total, shards))
    assert sum(r.size for r in rows if r.shard != r.old_shard) <= least + 0.005 * total
    assert max(sizes.values()) - min(sizes[k] for k in range(shards)) <= 0.05 * total / shards  # 1,000 rows of 2.5 kB


def test_a_giant_row_leaves_the_other_shards_equal(spark):
    docs = spark.createDataFrame([(0, "x" * 50_000)] + [(i, "y" * (i % 97)) for i in range(1, 2000)], "doc_id bigint, text string")
    sizes = collections.Counter()
    for r in resharding.reshard(docs, shards=6).collect():
        sizes[r.shard] += r.size
    rest = sorted(sizes.values())[:-1]
    assert len(rest) == 5 and rest[-1] - rest[0] <= 0.03 * rest[0] and max(sizes.values()) <= 50_001 + 300


def test_rewritten_rows_are_read_back(spark, odd, empty):
    rows = resharding.rewritten(odd).collect()
    check_layout(rows, texts(odd), 16)
    assert resharding.rewritten(empty).count() == 0


# -- 9 ---------------------------------------------------------------------------------------------


def plain_base(text):
    text = text or ""
    w = words_ws(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = {g for g, n in collections.Counter(grams).items() if n > 1}
    covered = {k + j for k, g in enumerate(grams) if g in often for j in range(3)}
    lines = [x for x in text.split("\n") if words_ws(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_columns(spark, odd):
    docs = both(spark, odd)
    got = quality.judge(docs, quality.Model()).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == collections.Counter((d, *plain_base(t)) for d, t in texts(docs))
    assert all(r.kept == (not r.base_failed) for r in got)


@has_data
def test_quality_tells_labelled_documents_apart(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = quality.fit(docs, labels)
    assert quality.fit(docs, labels) == model
    rows = quality.judge(docs, model).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.35 * len(bad)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in quality.judge(docs, model).where("kept").select("doc_id").collect())


def test_quality_score_is_the_mean_weight(spark):
    """One document's score from its grams by hand."""
    weights = tuple(((i * 7919) % 1000) / 1000 for i in range(quality.BUCKETS))
    docs = spark.createDataFrame([(1, "Foo bar 12 FOO!")], "doc_id bigint, text string")
    frame = quality._grams(quality.with_words(docs, "doc_id", "text")).select("_shapes", "_grams").first()
    assert frame[0] == ["Aa", "a", "0", "A!"] and len(frame[1]) == 7
    got = quality.judge(docs, quality.Model(weights, 0.0)).first().score
    assert got == pytest.approx(sum(weights[g] for g in frame[1]) / 7, rel=1e-6)


def test_quality_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.fit(odd, none)
    assert model == quality.Model() and quality.judge(empty, quality.fit(empty, none)).count() == 0 and quality.keep_good(empty, model).count() == 0
    labels = spark.createDataFrame([(4, 1), (5, 1), (None, 1), (9, None), (4, 1)], "doc_id bigint, quality int")
    assert quality.judge(odd, quality.fit(odd, labels)).count() == len(ODD)


# -- 10 --------------------------------------------------------------------------------------------


@has_data
def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    again = {r.doc_id: r.lang_pred for r in langid.identify(changed).collect()}
    assert again == {r.doc_id: r.lang_pred for r in rows}  # held-out labels are never used


def test_language_kernel_by_hand():
    a, b = "abab", "abc"

    def grams(t, n):
        return {t[i : i + n] for i in range(len(t) - n + 1)}

    want = np.mean([len(grams(a, n) & grams(b, n)) / np.sqrt(len(grams(a, n)) * len(grams(b, n))) if grams(a, n) and grams(b, n) else 0 for n in (1, 2, 3, 4)])
    x = langid.presences([a, b])
    assert float(x[0] @ x[1]) == pytest.approx(want, rel=1e-5)
    long = langid.presences(["ab" * 70_000, "ba" * 3])
    assert np.array_equal(long[0] > 0, langid.presences(["ab" * 10])[0] > 0)


def test_language_of_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[9].lang_pred == "und" and got[9].score == 0.0 and got[10].lang_pred != "und"
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_shared_folder(spark):
    assert common.shared_dir(spark) == common.shared_dir(spark)
    kept = common.materialize(spark.range(5).toDF("a"), "t")
    assert kept.count() == 5
