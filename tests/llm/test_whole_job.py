"""Cases in which an operator once did less than the whole job."""

import itertools
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from planloom.llm import decontaminate, html_text, langid, licenses, quality, queries, similar, simhash, token_output
from planloom.llm.common import materialize

DATA = "/root/testdata"
has_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no sample tables")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(rows):
    """Ids that stay of (id, text) rows with ids: the least of each component of pairs with a similarity of 0.8."""
    sets = [(d, plain_shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (c, a), (d, b) in itertools.combinations(sets, 2):
        if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
            x, y = sorted((find(c), find(d)))
            root[y] = x
    return sorted(d for d in root if find(d) == d)


@has_data
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_near_dedup_stage_against_brute_force(spark, size):
    docs = spark.read.parquet(f"{DATA}/{size}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, f"{DATA}/{size}")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_near_dedup_of_large_groups(spark):
    """A chain of near copies, and many texts that share a passage: buckets of more than a few rows."""
    chain = [" ".join(f"w{k}" for k in range(i, i + 60)) for i in range(0, 120, 3)]
    passage = " ".join(f"p{k}" for k in range(60))
    shared = [passage + " " + " ".join(f"u{i}x{k}" for k in range(5 + i % 20)) for i in range(120)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(chain + shared)]
    got = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in got) == plain_kept([r[:2] for r in rows])


def roots_of(pairs, names):
    """The components, as sorted lists, that pairs make of names."""
    groups = {n: {n} for n in names}
    for x, y in pairs:
        if groups[x] is not groups[y]:
            groups[x] |= groups[y]
            for n in groups[y]:
                groups[n] = groups[x]
    return sorted({tuple(sorted(g)) for g in groups.values()})


def test_near_dedup_goes_by_fingerprints_first(spark, monkeypatch):
    """The index of variants gives the first pairs; the exact join compares only what their links leave apart."""
    rng, asked, rounds = random.Random(5), [], []
    whole, variants = similar._compared, simhash.variants
    monkeypatch.setattr(simhash, "variants", lambda prints, *more: (asked.append(prints.columns), variants(prints, *more))[1])

    def compared(pairs, texts, first):
        pairs = materialize(pairs, "seen")
        found = whole(pairs, texts, first)
        rounds.append([{tuple(r) for r in x.collect()} for x in (pairs, found)])
        return found

    monkeypatch.setattr(similar, "_compared", compared)
    texts = []
    for group in range(12):
        words = [f"g{group}w{k}" for k in range(300)]
        for _ in range(4):
            copy = list(words)
            for at in rng.sample(range(300), 2):
                copy[at] = f"x{rng.random()}"
            texts.append(" ".join(copy))
    rows = [(i, t, "en", "a", 1) for i, t in enumerate([*texts, None, "", "a b"])]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), DATA)
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept([r[:2] for r in rows]) == [*range(0, 48, 4), 48, 50]
    assert asked == [["fp", "fp2", "class"]]
    names = {similar._class(similar.shingles(t.encode())) for t in texts}
    names = {n - (1 << 64) if n >> 63 else n for n in names}
    linked = roots_of(rounds[0][1], names)
    assert len(linked) == 12 and all(len(g) == 4 for g in linked)  # fingerprints found every group of such copies
    assert all(not any({a, b} <= set(g) for g in linked) for pairs, _ in rounds[1:] for a, b in pairs)


def test_fingerprint_index_of_sets(spark):
    """Small, searched and indexed-again buckets: pairs within fifteen bits of 128 are linked, and no pair over 32 is given."""
    rng = np.random.default_rng(9)

    def cloud(n, weak):
        centre, flips = rng.integers(0, 2, 128, dtype=np.uint8), np.zeros((n, 128), np.uint8)
        flips[:, weak] = rng.random((n, len(weak))) < 0.3
        return np.packbits(centre ^ flips, axis=1, bitorder="little").view(np.uint64)

    def held(values, pairs, names):
        far = np.bitwise_count(values[:, None] ^ values[None]).sum(axis=-1)
        assert all(far[a, b] <= simhash.SET_DISTANCE for a, b in pairs)
        groups = {n: g for g in roots_of(pairs, names) for n in g}
        assert all(groups[a] is groups[b] for a, b in np.argwhere(far <= 15).tolist())

    for n, weak in ((60, range(0, 128, 4)), (300, range(128)), (300, range(40, 100))):
        values = np.concatenate([cloud(n, np.array(weak)) for _ in range(2)])
        rows = [(i, *v) for i, v in enumerate(values.view(np.int64).tolist())]
        pairs = simhash.close_sets(spark.createDataFrame(rows, "class bigint, fp bigint, fp2 bigint")).collect()
        assert all(p.a < p.b for p in pairs)
        held(values, pairs, range(len(values)))
    values = cloud(simhash.REINDEXED + 200, np.arange(50, 110))  # segments 0 and 7 (bits 112 up) are shared
    for at in (3, 115):
        found = simhash._links(np.full(len(values), at << 32 | 7, np.int64), values, np.arange(len(values)), simhash.SET_SEGMENTS, simhash.SET_DISTANCE)
        held(values, [(a, b) for x, y in found for a, b in zip(x.tolist(), y.tolist())], range(len(values)))


def test_rows_are_decided_one_by_one(spark):
    """Repeated and null ids: near-dedup and decontamination look at a row's own text."""
    leak = "one two three four five six seven eight nine ten eleven"
    texts = [(1, "same text"), (1, "same text"), (None, "same text"), (None, "no id"), (None, "no id"), (2, leak), (2, "clean"), (None, leak)]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in texts], DOCS)
    shown = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert shown(simhash.keep_one(docs)) == sorted([(1, "same text"), (None, "no id"), (2, leak), (2, "clean")], key=str)
    bench = spark.createDataFrame([(7, leak)], "item_id bigint, text string")
    assert shown(decontaminate.remove_contaminated(docs, bench)) == sorted(texts[:5] + [(2, "clean")], key=str)


def test_licence_prefilter_lets_every_anchor_through(spark):
    model = licenses.fit()
    texts = [t for family in licenses.TEMPLATES.values() for t in family] + [f"x {a} y" for a in licenses.ANCHORS]
    texts += ["Released under the BSD 3-Clause terms", "Distributed under GPL v3", "Text is available under CC BY-SA 4.0", "Provided AS IS, without warranty", "CC-BY", "rights. -- reserved"]
    found = licenses._scored(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model, "doc_id", "text")
    assert [texts[r.id] for r in found.collect() if r.paragraph is None] == []


PROSE = "This is the text of the page, and it has a long line that was written for the test in this file."


def test_html_head_without_an_end_tag():
    for after in ("<body><article><p>", "<article><p>", "<p>", "<body class=x><main><div>"):
        assert html_text.main_text(f"<html><head><title>T</title><meta charset=utf-8>{after}{PROSE}") == PROSE
    assert html_text.main_text(f"<head><title>T</title><style>p {{}}</style>lost</head><body><p>{PROSE}") == PROSE


def test_html_svg_without_content_or_end():
    for tag in ('<svg class="icon"/>', "<svg>", "<template>", "<noscript>"):
        assert html_text.main_text(f"<body><article>{tag}<p>{PROSE}</p></article>") == PROSE
    assert html_text.main_text(f"<article><svg/><p>{PROSE}</p><svg><text>no</text></svg></article>") == PROSE
    assert html_text.main_text(f"<article><p>{PROSE}</p><script>never shown") == PROSE


def test_html_pages_in_other_languages():
    texts = [
        "Вчера вечером жители города собрались на площади, чтобы обсудить новый план развития района и парка.",
        "Wczoraj wieczorem mieszkańcy miasta zebrali się na rynku, aby omówić nowy plan rozwoju dzielnicy i parku.",
        "Dün akşam şehir sakinleri meydanda toplanarak yeni gelişim planını ve park projesini uzun uzun tartıştılar.",
        "昨天晚上，城市居民聚集在广场上讨论新的区域发展计划和公园建设方案，会议持续了三个小时，许多人发表了意见。",
        "Tegnap este összegyűltek lakosok téren, hogy megvitassák kerület fejlesztési tervét, valamint parkot és iskolát.",
    ]
    for text in texts:
        assert text in html_text.main_text(f"<body><nav><a href=x>{text}</a></nav><div><p>{text}</p><p>{text}</p></div></body>").split("\n")


def test_spans_of_repeated_ids_and_clashing_names(spark):
    """Spans go from the row whose text has them; helper names of the operators may be columns of the input."""
    leak = "one two three four five six seven eight nine ten"
    rows = [(1, f"a {leak} b"), (1, "clean alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, f"{leak} c"), (None, None), (None, "")]
    names = ["_row", "_id", "_hits", "_lost", "_pieces", "_kept", "_bad", "k1", "k2", "whole", "row", "root", "class", "hits", "lost", "pieces", "id", "size", "words", "gram"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(7, leak)], "item_id bigint, text string")
    got = decontaminate.remove_spans(docs, bench)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a b"), (1, rows[1][1]), (None, "c"), (None, None), (None, "")], key=str)
    assert decontaminate.remove_contaminated(docs, bench).count() == 3
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 4


def test_every_language_is_learned(spark):
    """More languages than once fitted, one of them with most of the rows under one id and one text."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzабвгдежзиклмнопрстуфхцчшыья"
    vocabulary = {f"l{k:03}": ["".join(rng.choices(letters, k=5)) for _ in range(12)] for k in range(230)}
    rows, held = [(i * 16 + 1, " ".join(rng.choices(w, k=9)), lang) for lang, w in vocabulary.items() for i in range(6)], []
    rows += [(1, "one text of many rows and of one id", "zz")] * 3000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, per_class=20)
    assert model.classes == sorted({*vocabulary, "zz"})
    held = [(lang, " ".join(rng.choices(w, k=9))) for lang, w in vocabulary.items()]
    got = model.predict([t for _, t in held])[0]
    assert sum(a == b for a, (b, _) in zip(got, held)) >= 0.95 * len(held)


def test_language_model_is_ridge_regression(spark):
    """With every text a landmark, Nystroem is exact: the scores are those of plain kernel ridge regression."""
    texts = ["the cat sat on the mat", "a dog and a cat", "der Hund und die Katze", "ein Haus am See", "le chat et le chien"]
    langs = ["en", "en", "de", "de", "fr"]
    model = langid.Model(texts, langs, ridge=0.1)
    x = langid.presences(texts).astype(np.float64)
    kernel, classes = x @ x.T, sorted(set(langs))
    balance = np.diag([len(texts) / (len(classes) * langs.count(c)) for c in langs])
    target = np.array([[1.0 if c == k else -1.0 for k in classes] for c in langs])
    # least squares with weights, in the landmarks' span: (K B K + rn (K + eps)) a = K B y
    alpha = np.linalg.solve(kernel @ balance @ kernel + 0.1 * len(texts) * (kernel + 1e-6 * np.eye(5)), kernel @ balance @ target)
    new = langid.presences(["the dog and the house", "das Haus und der Hund"])
    assert np.allclose(new @ model.weights, new.astype(np.float64) @ x.T @ alpha, atol=1e-4)


def test_quality_ratio_is_of_two_distributions():
    raw, target = [5, 0, 20, 1], [3, 0, 0, 1]
    p, q = quality.distributions(raw, target)
    assert sum(p) == pytest.approx(1) and sum(q) == pytest.approx(1) and min(p + q) > 0
    assert quality.ratio(raw, target) == pytest.approx([np.log(b / a) for a, b in zip(p, q)])


def test_quality_fit_takes_one_score_for_each_id(spark):
    words = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(1, words)] * 3000 + [(2, "x " * 90)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    assert len(model.weights) == quality.BUCKETS and all(r.kept for r in quality.judge(docs.where("doc_id = 1").limit(3), model).collect())


def plain_license(model, line):
    """A paragraph's family, its probability and whether a template confirms it."""
    w = licenses.words(line)
    grams = licenses.ngrams(w)
    known = [g for g in grams if g in model.weights]
    scale = len(known) ** -0.5 if known else 0.0
    p = licenses._softmax([b + scale * sum(model.weights[g][c] for g in known) for c, b in enumerate(model.bias)], model.temperature)
    if 1 - p[0] < model.some:
        return licenses.NONE, False
    best = p.index(max(p[1:]), 1)
    triples = {g for g in grams if g.count(" ") == 2}
    cover = max(len(set(t) & grams) / max(1, min(len(t), max(3, len(triples)))) for f, t in licenses._templates() if f == model.classes[best])
    confirmed = cover >= licenses.COVERED
    return (model.classes[best], confirmed) if confirmed or p[best] >= model.least else (licenses.UNKNOWN, False)


def test_licences_against_a_plain_version(spark):
    model = licenses.fit()
    assert 0 < model.some < 1 and 0 < model.least < 1
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts] + licenses.OTHER
    texts += ["Released under the BSD 3-Clause terms", "Distributed under GPL v3", "This program is covered by the GPL, version 3 or later.", "Content available under CC BY-SA 4.0.", "x mit y", "Shared under the Frobnicator licence"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.license, r.confirmed) for r in licenses.scan(docs, model).collect()}
    want = {i: plain_license(model, t) for i, t in enumerate(texts)}
    assert got == want
    families = [f for f, ts in licenses.TEMPLATES.items() for _ in ts]
    assert all(want[i] == (f, True) for i, f in enumerate(families))
    assert sum(want[len(families) + i][0] == "none" for i in range(len(licenses.OTHER))) >= 0.9 * len(licenses.OTHER)


def test_licences_of_wrapped_and_long_paragraphs(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the Software\nwithout restriction, including without limitation the rights to use, copy,\nmodify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    long = " ".join(f"w{i}" for i in range(60_000)) + " licensed under the terms"
    docs = spark.createDataFrame([(1, "Intro.\n" + notice + "\nEnd."), (2, long), (3, "One short line\nof two"), (4, "A line without an end that is longer than forty\nBut a capital follows")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].n_paragraphs for i in (1, 2, 3, 4)] == [3, 1, 2, 2] and got[1].license == "MIT" and got[1].n_license == 1


def test_html_container_names_that_speak_of_the_page():
    page = '<body><div class="{}"><main><article><h1>Title</h1><p>{}</p></article></main><div class="sidebar"><p>{}</p></div></div></body>'
    for name in ("content-sidebar-wrap", "sidebar-left-layout", "has-sidebar", "nav-open"):
        assert html_text.main_text(page.format(name, PROSE, "Other things that are on the site and are not of the text of this page.")) == "Title\n" + PROSE
    for name in ("social-science", "news-search-engine", "legal-history"):
        assert html_text.main_text(f'<body><div class="{name}"><p>{PROSE}</p></div><div class="newsletter"><p>Sign up for the letter of the week, and have it in your mail on the same day.</p></div></body>') == PROSE
    for name in ("search-box", "social-links", "comments", "comment-list", "article-ad", "cookie-banner", "reader-comments"):
        inner = "<article><p>The best of the posts that I have read on the site in a year, and I say it to all.</p></article>" if "comment" in name else "<p>Find what is on the site by the word that you have in your mind, and press the key.</p>"
        assert html_text.main_text(f'<body><article><p>{PROSE}</p></article><div class="{name}">{inner}</div></body>') == PROSE


def test_html_paragraphs_that_are_links_or_no_prose():
    link = '<p><a href="x">This is the whole of a paragraph of the article that was made into one long link by its author.</a></p>'
    code = "<pre>" + " ".join(f"x{i}=f(x{i - 1});" for i in range(1, 12)) + "</pre>"
    got = html_text.main_text(f"<body><nav><a href=a>One</a></nav><article><p>{PROSE}</p>{link}{code}<p>{PROSE}</p><ul><li><a href=y>More of it</a></li></ul></article></body>").split("\n")
    assert len(got) == 4 and got[1].startswith("This is the whole") and got[2].startswith("x1=f(x0)")


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    assert token_output.takes_words(path) and not token_output.takes_words(queries.tokenizer_path("byte_bpe_50k.json"))
    said = json.loads(Path(path).read_text())
    said["normalizer"]["normalizers"].pop()  # the same, but letters keep their case
    other = tmp_path / "other.json"
    other.write_text(json.dumps(said))
    texts = ["The  Cat's\nTEN 10 tries, naïve Ünïcode!", "", "<|endoftext|> x", "e\u0301 ABC"]
    for file in (path, queries.tokenizer_path("byte_bpe_50k.json"), str(other)):
        library, encode = Tokenizer.from_file(file), token_output.Encoder(file)
        got = [list(np.frombuffer(x, "<i4")) for x in encode([t.encode() for t in texts])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_forms_of_a_word_are_one_lookup():
    """Capitals and marks around a word cost no work in Python for each form."""
    from tokenizers import Tokenizer

    path, calls = queries.tokenizer_path(), [0]
    forms = ["".join(x) + mark for x in itertools.product(*[(c, c.upper()) for c in "niñacámara"]) for mark in ("", ",", ")!")]
    encode, text = token_output.Encoder(path), " ".join(forms)
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event == "call")))
    try:
        got = encode([text.encode()])
    finally:
        sys.setprofile(None)
    assert list(np.frombuffer(got[0], "<i4")) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert calls[0] < len(forms) / 10


def test_units_of_odd_texts(monkeypatch):
    """Texts of all sorts of bytes, cut into spans at every white space, have the ids of whole-text encoding."""
    from tokenizers import Tokenizer

    rng, path = random.Random(4), queries.tokenizer_path()
    parts = [*"abzAZ019 \n\t\x0b\x0c\r\x1c\x1f\x00\x7f'<>|_-.,!?$`~", "'s", "'LL", "<|endoftext|>", *"áÁÀÞþßÿŸ×÷ªºµ²½¡¿\xa0\x85\xad", *"ŉİıſKǅ\u03a3\u03c2\u0436\u0416\u4e2d\u0301\u200b\u2028\ufffd\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.choice((0, 1, 2, 5, 30)))) for _ in range(4000)]
    raw = [t.encode() for t in texts] + [bytes(rng.choices((0x20, 0x41, 0x61, 0x80, 0x97, 0x9E, 0xB7, 0xC2, 0xC3, 0xC4, 0xFF), k=6)) for _ in range(1000)]
    library = Tokenizer.from_file(path)
    want = [library.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in raw]
    for span in (1, token_output.Encoder.SPAN):
        monkeypatch.setattr(token_output.Encoder, "SPAN", span)
        for words in (50, 100_000):
            encode = token_output.Encoder(path, words)
            assert [np.frombuffer(x, "<i4").tolist() for x in encode(raw)] == want
    column = pa.array([None, *raw, b"", None], pa.binary()).slice(1)
    ids, sizes = encode.column(column)
    assert sizes.tolist() == [*map(len, want), 0, 0] and ids.tolist() == [i for x in want for i in x]
    assert [len(x) for x in token_output.Encoder(path).column(pa.array([], pa.binary()))] == [0, 0]
