"""Edge cases and brute force for the operators on texts."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodemill.llm import bpe_trie, html_text, labelled, line_crf, mixing, near_duplicates, phrase_prints, token_files, topk_search, url_filter, zstd_toxicity
from lodemill.llm.queries import vocabulary
from lodemill.llm.star_components import components
from lodemill.llm.common import Scratch

ODD = [None, "", " ", "one", "a b", "  two  spaces \n \n x", "tab\t \tend ", "don't we'll \u00e9t\u00e9 \u65e5\u672c\u8a9e 1234 <|endoftext|>x <|endoftext|>", "\0nul \0", "word " * 3000, "\U0001f642" * 50, "x" * 5000, "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    """Null ids, repeated rows, extra columns with clashing names."""
    rows = [(i, t, "score", "key") for i, t in enumerate(ODD)] + [(None, "no id", "s", "k"), (3, "one", "s", "k"), (3, "one", "s", "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, key string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abzAZ  \n\t.,'!19\u00e9\u00df\u65e5\u00a0\0s<|>", "the", " of", "'ll", "<|endoftext|>", "\U0001f642"]), max_size=40).map("".join))
def test_both_encoders_equal_the_library(text):
    enc, bpe = token_files.piece_encoder(vocabulary()), bpe_trie.trie_bpe(vocabulary())
    want = enc.tok.encode(text, add_special_tokens=False).ids
    twice = pa.array([text, "", text])
    for code in (enc, bpe.batch):
        ids, start = code(twice)
        assert ids.tolist() == want * 2 and start.tolist() == [0, len(want), len(want), 2 * len(want)]
    assert bpe.decode(want) == enc.tok.decode(want, skip_special_tokens=False) == bpe.decode(bpe.encode(text))
    assert bpe.decode_all(ids, start).to_pylist() == [bpe.decode(want), "", bpe.decode(want)]


def test_a_small_memory_gives_the_same_ids():
    texts = [f"w{k} the, {'x' * (k % 80)} of{k % 7}.\n\n q" for k in range(300)]
    small, large = token_files.PieceEncoder(vocabulary(), limit=5), token_files.piece_encoder(vocabulary())
    trie, whole = bpe_trie.TrieBPE(vocabulary(), limit=5), bpe_trie.trie_bpe(vocabulary())
    for _ in range(2):
        for i in range(0, 300, 7):
            some = pa.array(texts[i : i + 7])
            for one, other in ((small, large), (trie.batch, whole.batch)):
                assert all((a == b).all() for a, b in zip(one(some), other(some), strict=True))
    assert len(small.code.known.keys) <= 5 >= len(trie.code.tokens.keys)


def test_bpe_rows(spark, docs, empty, tokenizer):
    got = bpe_trie.bpe_round_trip(docs, vocabulary()).collect()
    assert len(got) == docs.count()
    want = sorted((r.doc_id is None, r.doc_id or 0, len(i := tokenizer.encode(r.text or "", add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe_trie.bpe_round_trip(empty, vocabulary()).count() == 0


def test_token_files(spark, docs, empty, tokenizer):
    got = sorted(token_files.token_digest(spark, docs, vocabulary()).collect(), key=lambda r: r.start)
    at = 0
    for r, d in zip(got, sorted(docs.collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0, d.text or "")), strict=True):
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_digest(spark, empty, vocabulary()).count() == 0


PAGE = """<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a> <a href=/x>More</a></nav>
<div class="cookie-notice">We use cookies.</div><div id="sidebar"><ul><li><a href=/>One</a><li><a href=/>Two</a></ul></div>
<article><h1>Title &amp;&nbsp;more</h1><p>First <b>bold</b>
 line.<p>Second &lt;b&gt; caf&eacute; &#8212; long enough to be some text.</p><script>var x = "<p>no</p>";</script><ul><li>Point one.</li><li>Point two.</ul></article>
<div class="comments"><div class="comment">I liked it, thanks for sharing this.</div></div><form><input><button>Send</button></form><footer>&copy; 2020 Site</footer>"""


def test_html_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>x"), (4, "u", "<<>< <!-- <p> " * 50), (5, "u", "<div>" * 3000 + "deep"), (1, "u", PAGE)]
    d = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(d).collect()
    assert len(got) == 7
    text = next(r.text for r in got if r.page_id == 1)
    assert text == "Title & more\nFirst bold line.\nSecond <b> caf\u00e9 \u2014 long enough to be some text.\nPoint one.\nPoint two."
    assert {r.page_id: (r.text, r.n_chars) for r in got}[2] == ("", 0)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(d.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["button", "select", "noscript", "template"])
def test_html_unended_elements(tag):
    leaves = lambda page: [x for x in html_text.parse(page).text if x]
    assert leaves(f"<div><{tag}>Menu</div><p>One.</p>") == ["One."]
    assert leaves(f"<{tag}>Menu<article><p>One.</p></article>") == ["One."]
    assert leaves(f"<{tag}>Menu<p>One.</p><{tag}>Share</{tag}><p>Two.</p>") == ["One.", "Two."]
    assert leaves(f"<p>One.</p><{tag}><div>Menu</div></{tag}><p>Two.</p>") == ["One.", "Two."]
    assert leaves(f"<p>One.</p><{tag}>Menu") == ["One."]
    assert leaves(f"<{tag}>" * 20000 + "<p>One.</p>") == ["One."]


def test_html_nested_objects_and_formulas():
    leaves = lambda page: [x for x in html_text.parse(page).text if x]
    assert leaves("<p>As <object data=x>a <object>b</object> c</object> shows.</p>") == ["As a b c shows."]
    assert leaves("<p>See <svg><g><path d='M0'/><text>axis</text></g></svg> here.</p><svg><p>One.</p>") == ["See axis here.", "One."]
    assert leaves("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>") == ["Let x=2 be."]
    assert leaves("<p>One.</p><script>a<p>b") == ["One."]


@pytest.mark.parametrize("part", ["<a \"", "</x", "<div>", "<b></i>", "<p><b>", "<a \">\" <b '", "<button>", "<td><p>", "<!--", "<", "&amp", "<a class='x", "<script>"])
def test_html_takes_time_in_proportion_to_the_page(part):
    import time

    def seconds(n):
        page = part * (n // len(part))
        began = time.process_time()
        html_text.parse(page)
        return time.process_time() - began

    seconds(1 << 14)
    assert seconds(1 << 20) < 60 * max(0.05, seconds(1 << 16))


def test_html_pages_with_names_never_seen():
    page = """<body><div class="qzx"><a href=/>Home</a> <a href=/b>About us</a> <a href=/c>Contact</a></div><section id="vrk"><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li><li><a href=/3>Three</a></li></ul></section>
    <article class="wuf"><h1>What the river did last spring</h1><p>It rose above the old bridge, and the town waited for the night to end.</p><p>By morning the water had gone, and the square was full of mud and boats.</p></article>
    <footer class="jyp">&copy; 2020 Nobody</footer></body>"""
    assert html_text.default_model().text(page).split("\n") == ["What the river did last spring", "It rose above the old bridge, and the town waited for the night to end.", "By morning the water had gone, and the square was full of mud and boats."]


def test_html_model_on_unseen_labelled_pages():
    model, wrong, total = html_text.default_model(), 0, 0
    for page in html_text.labelled_pages(80, seed=77):
        t = html_text.parse(page)
        y, p = html_text._labels(t), model.marginals(t)
        leaves = [k for k, tag in enumerate(t.tag) if not tag]
        wrong, total = wrong + sum((p[k] >= 0.5) != y[k] for k in leaves), total + len(leaves)
    assert wrong < 0.015 * total


def test_tree_marginals_are_exact():
    from itertools import product

    m = html_text.Model()
    m.weight = {"bias": 0.3, "tag div": -0.4, "tag p": 0.8, "leaf": 0.2, "in p": 0.5}
    m.edge = [[[0.5, -0.2], [-0.3, 0.9]] for _ in m.edge]
    m.freeze()
    t = html_text.parse("<div><p>a</p><p>b</p></div><div>c</div>")
    unary = [sum(m.weight.get(f, 0.0) for f in m.features(t, k)[0]) for k in range(len(t.tag))]
    z, one = 0.0, np.zeros(len(t.tag))
    for y in product((0, 1), repeat=len(t.tag)):
        w = np.exp(sum(u * s for u, s in zip(unary, y, strict=True)) + sum(m.edge[m.features(t, k)[1]][y[t.parent[k]]][y[k]] for k in range(1, len(y))))
        z, one = z + w, one + w * np.array(y)
    assert np.allclose(m.marginals(t), one / z)


def test_crf_marginals_are_exact():
    from itertools import product

    u, edge = np.array([0.5, -1.0, 0.2, 0.7, -0.3]), np.array([[0.4, -0.1], [-0.6, 0.3]])
    p, joint = line_crf.forward_backward(u, edge, np.array([0, 3]), np.array([3, 2]))
    for at, n in ((0, 3), (3, 2)):
        z, one = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=n):
            w = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(edge[y[i], y[i + 1]] for i in range(n - 1)))
            z, one = z + w, one + w * np.array(y)
        assert np.allclose(p[at : at + n], one / z)
    assert abs(joint.sum() - 3) < 1e-9


GOOD, BAD = "The quick fox runs over there, and nothing else happens today.\n", "BUY!! NOW!! ### $$$ ###\nBUY!! NOW!! ### $$$ ###\n"


def test_quality(spark, docs, empty):
    texts = [(i, (GOOD if i % 2 else BAD) * (1 + i % 5) + f"line {i}.") for i in range(300)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = line_crf.fit(d, labels)
    got = line_crf.score(d, model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert line_crf.score(docs, model).count() == docs.count() and line_crf.score(docs, model).where("score is null or isnan(score)").count() == 0
    kept = line_crf.good_documents(docs, model)
    assert kept.columns == docs.columns and line_crf.good_documents(empty, model).count() == 0
    none = line_crf.fit(d, labels.limit(0))
    assert line_crf.score(docs, none).where("score <> 0.5").count() == 0


def test_quality_scores_by_brute_force():
    from itertools import product

    rows = [((GOOD if k % 2 else BAD) * (1 + k % 2) + f"line {k}.", k % 2) for k in range(60)]
    model = line_crf.train(rows)
    texts = [GOOD + BAD, "one\n\n two two\n| 3 |", GOOD * 3 + "x", "\n \n", "", "A\nA\nA!"]

    def brute(text):
        lines = [x for x in text.split("\n") if x.strip()]
        if not lines:
            p = 0.5
        else:
            own = np.vstack([line_crf.line_features([x], np.array([lines.count(x)])) for x in lines])
            none = np.zeros(line_crf.OWN - 1)
            x = [np.concatenate([own[k], own[k - 1][1:] if k else none, own[k + 1][1:] if k + 1 < len(lines) else none]) for k in range(len(lines))]
            z, one = 0.0, np.zeros(len(lines))
            for y in product((0, 1), repeat=len(lines)):
                w = np.exp(sum(s * (v @ model.weight) for s, v in zip(y, x, strict=True)) + sum(model.edge[a, b] for a, b in zip(y, y[1:], strict=False)))
                z, one = z + w, one + w * np.array(y)
            size = np.array([len(x) for x in lines])
            p = (one / z) @ size / size.sum()
        return 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * p)))

    assert np.allclose(model.scores(texts), [brute(t) for t in texts])
    whole = line_crf.Lines(texts)
    assert np.allclose(whole.unary(model.weight, step=2), whole.features(0, len(whole.flat)) @ model.weight)


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeioutnrsl"), 6)) for _ in range(400)]
    bad = ["hatefulword", "vileinsult", "nastyslur"]
    rows = []
    for i in range(400):
        w = list(rng.choice(words, 120))
        if i % 4 == 0:
            for k in range(3):
                w.insert(int(rng.integers(100)), bad[(i // 4 + k) % 3])
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = zstd_toxicity.fit(d, labels)
    got = zstd_toxicity.score(d, model).collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    out = zstd_toxicity.score(docs, model)
    assert out.count() == docs.count() and out.where("score is null or isnan(score)").count() == 0
    assert out.where("doc_id = 1").first().score == 0.0
    assert zstd_toxicity.clean_documents(empty, model).columns == empty.columns
    none = zstd_toxicity.fit(d, labels.limit(0))
    assert zstd_toxicity.score(d, none).where("predicted = 1").count() == 0


def test_toxicity_scores_are_compression_lengths():
    import math

    import zstandard

    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioutnrsl"), 6)) for _ in range(300)]
    rows = [(" ".join([*rng.choice(words, 60), *(["hatefulword"] if k % 3 == 0 else []), *rng.choice(words, 30)]), int(k % 3 == 0)) for k in range(150)]
    model = zstd_toxicity.train(rows)
    assert model.toxic and model.ordinary

    def size(content, window):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(6, dict_size=len(content), source_size=200, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(compression_params=p)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(window))

    def brute(text):
        w = text.lower().split()
        if not w:
            return 0.0
        saved, at = [], 0
        while True:
            window = (" " + " ".join(w[at : at + 24]) + " ").encode()
            saved.append(size(model.ordinary, window) - size(model.toxic + model.ordinary, window))
            at += 22
            if at >= len(w) - 2:
                break
        top = sorted(saved, reverse=True)
        over = sum(s - 2 for s in saved if s > 2)
        x = [1, *(max(0, t) / 4 for t in (top + [0, 0, 0])[:3]), math.log1p(over), over / len(saved), math.log1p(len(saved)) / 4, sum(saved) / len(saved)]
        return 1 / (1 + math.exp(-float(np.dot(x, model.curve))))

    texts = [t for t, _ in rows[:20]] + ["", "  \n", "one", "x" * 9000, "a b " * 3000, *(" ".join(words[:n]) for n in (23, 24, 25, 26, 27, 46, 47, 48, 49))]
    assert np.allclose(model.scores(texts), [brute(t) for t in texts])


def test_samples_come_to_the_driver_in_parts(spark, monkeypatch):
    monkeypatch.setattr(labelled, "PART_BYTES", 20_000, raising=False)
    rows = [(i, f"text {i} " * 100) for i in range(400)] + [(5, "less " * 100), (400, None), (401, "long " * 9000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = [(i, i % 2) for i in range(402)] + [(7, 0), (500, 1)]
    frame, most = type(d), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (out := collect(self), most.append(sum(len(getattr(r, "text", None) or "") for r in out)))[0])
    got = labelled.sample(d, spark.createDataFrame(marks, "doc_id long, toxic int"), "toxic", labelled.F.col("doc_id") % 10 != 3, 90, 20_000)
    place = lambda i: hashlib.md5(f"toxic|{i}".encode()).hexdigest()
    usable = sorted((place(i), i) for i in range(400) if i != 7 and i % 10 != 3)
    kept = sorted([x for x in usable if x[1] % 2 == 0][:90] + [x for x in usable if x[1] % 2 == 1][:90])
    assert got == [("less " * 100 if i == 5 else f"text {i} " * 100, i % 2) for _, i in kept]
    assert max(most) < 60_000


def test_toxicity_needs_two_of_each_label():
    for rows in ([], [("a b", 1)], [("a", 0)] * 5, [("a b", 1), ("c", 0), ("d", 0)]):
        model = zstd_toxicity.train(rows)
        assert np.allclose(model.scores(["a b", "", "c"]), 0.05)
    assert zstd_toxicity.train([("a b", 1), ("a b", 1), ("c", 0), ("d", 0)]).scores(["", "a b"]).shape == (2,)


def brute_components(rows):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}, {i: len(s) for i, s in sets}


def test_near_duplicates(spark, docs, empty):
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(80)], []
    for k in range(90):
        w = list(base) if k < 60 else [f"q{k}_{i}" for i in range(70)]
        for _ in range(k % 4):
            w[int(rng.integers(len(w)))] = f"x{int(rng.integers(10**6))}"
        rows.append((1000 + k, " ".join(w)))
        if k >= 60:
            rows.append((2000 + k, " ".join(w).upper()))
    d = docs.select("doc_id", "text", "score", "key").unionByName(spark.createDataFrame([(*r, "s", "k") for r in rows], "doc_id long, text string, score string, key string"))
    got = near_duplicates.near_duplicates(d).collect()
    assert len(got) == d.count()
    comp, size = brute_components([(r.doc_id, r.text) for r in d.collect() if r.doc_id is not None])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (comp[r.doc_id], size[r.doc_id], comp[r.doc_id] == r.doc_id)
    assert near_duplicates.near_duplicates(empty).count() == 0
    kept = near_duplicates.distinct_documents(d)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i, c in comp.items() if i == c}


@pytest.mark.parametrize("block", [2 << 20, 4000])
def test_near_copies_behind_larger_leaders(spark, monkeypatch, block):
    """Earlier documents that hold the passage and more lead every bucket; the copies still find each other."""
    monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", block)
    x = [f"p{i}" for i in range(200)]
    rows = [(i, " ".join([*x, *(f"l{i}_{k}" for k in range(50))])) for i in range(150)]
    rows += [(1000, " ".join(x)), (1001, " ".join([*x, "end"]))]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    comp, _ = brute_components(rows)
    assert comp[1001] == 1000 and {r.doc_id: r.component_id for r in got} == comp


def test_texts_of_one_doc_id_are_one_node(spark):
    rows = [(1, "a b c d e f g"), (3, "a b c d e f g"), (3, "other words than those before it"), (4, "OTHER words than those before it"), (4, None), (5, "alone"), (None, "alone")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, n long")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(d).collect())
    assert got == [(0, 1, None, True), (1, 3, 1, True), (3, 2, 1, False), (3, 3, 1, False), (4, 0, 4, True), (4, 2, 1, False), (5, 1, 5, True)]
    assert sorted((r.doc_id or 0) for r in near_duplicates.distinct_documents(d).collect()) == [0, 1, 5]


def test_a_third_of_the_rows_are_copies(spark):
    rows = [(i, "same five words and more") for i in range(0, 300, 3)] + [(i, f"text number {i} stands here alone") for i in range(300) if i % 3]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 0 if i % 3 == 0 else i for i in range(300)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (7, 7), (None, 3), (200, 150), (1, 0)]
    d = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(d, Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[200] == 150 and len(got) == 46
    assert components(d.limit(0), Scratch(spark, "t")).count() == 0


def test_mix(spark, docs, empty):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w%d" % int(rng.integers(50)) for _ in range(int(rng.integers(0, 40)))]) or None, f"s{i % 7}" if i % 7 < 6 else None) for i in range(900)] + [(k, "big " * 9, "hot") for k in range(2000, 2600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", mixing.F.lit(1)).withColumn("size", mixing.F.lit("x"))
    got = mixing.mix(d).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, want = {}, {}
    while True:
        rest = [s for s in names if s not in full]
        level = (1.5 * sum(total.values()) - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * total[s]]
        want = full | {s: level * weight[s] for s in rest}
        if not over:
            break
        full |= {s: 2.0 * total[s] for s in over}
    source, taken = {i: s for i, _, s in rows}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(d.repartition(5)).collect()))
    copies = mixing.mixed_documents(d)
    assert copies.columns == d.columns
    times = {r.doc_id: r["count"] for r in copies.groupBy("doc_id").count().collect()}
    assert all(times.get(r.doc_id, 0) * r.size == r.taken for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mix_equals_its_sql(spark):
    """Digits only (the lowest weight), null and repeated doc_ids, null texts and sources."""
    import duckdb

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(str(int(rng.integers(10**6))) for _ in range(8)), "a" if i < 900 else "b") for i in range(1500)]
    rows += [(None, f"no id {k} " + "w " * (k % 5), "c") for k in range(200)] + [(7, f"repeated {k}", "d") for k in range(150)] + [(5000 + k, None, None) for k in range(5)] + [(6000 + k, f"{k} words", None) for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    t = d.toPandas().astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("t", t)
    want = con.execute(mixing.oracle("t")).fetchall()
    got = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(d).collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    total = {}
    for (_, _, size, target, _), taken in zip(got, (r[4] for r in got), strict=True):
        total[size, target] = total.get((size, target), 0) + taken
    assert all(abs(taken - target) <= 10 for (_, target), taken in total.items())


def test_url_rules(spark):
    urls = ["http://A.Example.org/es/x?q", "https://example.org/en/12", "https://x.com/fr/", "http://com/de/1#t", "http://notexample.org/es/", "http://a.org", None, "", "no scheme", "http://casino.example.net/", "http://mycasino.net/", "x://user@h.com:80/de/?://y", "http://ads-track.net", "http://h.org/\n/x"]
    d = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    for inline in (200, 0):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(d, inline=inline).collect()}
        assert [got[i] for i in range(6)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow"), (None, "allow")]
        assert [got[i] for i in range(6, 12)] == [(None, "allow")] * 3 + [(None, "block"), (None, "allow"), (None, "allow")]
        assert got[12] == (None, "block") and got[13] == ("org/", "allow") and got[14] == got[0]
    assert url_filter.filter_urls(d.limit(0)).count() == 0
    plan = url_filter.filter_urls(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) if rng.random() < 0.6 else 0.0 for v in rng.integers(-3, 4, 6) / 1024]) for i in range(-200, 700)]
    rows += [(800, None), (900, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, [float("nan")] * 6), (1100, []), (1200, [float("inf")] * 6), (None, [1.0] * 6), (5, [0.1] * 6), (1300, [1.0, 2.0])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (6 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for size in (topk_search.CHUNK_BYTES, 300):
        assert sorted(map(tuple, topk_search.top_k(d, chunk_bytes=size).collect())) == sorted(want)
    assert topk_search.top_k(d.limit(0)).count() == 0
    huge = spark.createDataFrame([(100, [1e13, 1.0]), (7, [1e13, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large for 64-bit"):
        topk_search.top_k(huge).collect()


def test_fingerprints(spark, docs, empty):
    got = phrase_prints.fingerprint_documents(docs).collect()
    rows = sorted(docs.collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0, d.text or ""))
    texts = [r.text or "" for r in rows]
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(t), hashlib.sha256(phrase_prints.edited(t, texts[(k + 1) % len(texts)]).encode()).hexdigest()) for k, (r, t) in enumerate(zip(rows, texts, strict=True)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= v <= 1 for r in got for v in (r.near_edited, r.near_next))
    same = {r.fingerprint for r in got if r.doc_id in (12, 13)}
    assert len(same) == 1 and phrase_prints.fingerprint_documents(empty).count() == 0
    lone = docs.where("doc_id = 12")
    assert phrase_prints.fingerprint_documents(lone).first().near_next == 1.0


def brute_prints(text):
    """The names of each level, phrase by phrase, and their one-permutation minima."""
    M = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & M
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & M
        return x ^ (x >> 32)

    names, out = [mix(ord(c) + 1) for c in text], []
    for _ in range(4):
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        sym = [x if n == 1 else mix((x + mix(n)) & M) for x, n in runs]
        label = sym
        for _ in range(3):
            new = []
            for k, x in enumerate(label):
                diff = x ^ label[k - 1] if k else 1
                low = (diff & -diff).bit_length() - 1 if diff else 64
                new.append(2 * low + (x >> low & 1))
            label = new
        cut = [k for k in range(len(sym)) if k == 0 or k + 1 < len(sym) and label[k - 1] > label[k] < label[k + 1]]
        names = []
        for a, b in zip(cut, [*cut[1:], len(sym)], strict=False):
            power, total = 1, 0
            for x in sym[a:b]:
                total, power = (total + mix(x) * power) & M, power * 0x9E3779B97F4A7C15 & M
            names.append(mix(total))
        bins = [None] * 32
        for x in names:
            h = mix(x ^ 0x9E3779B97F4A7C15)
            bins[h & 31] = h >> 8 if bins[h & 31] is None else min(bins[h & 31], h >> 8)
        row = []
        for k in range(32):
            near = [d for d in range(32) if bins[(k + d) % 32] is not None]
            v = 0 if not near else bins[k] if near[0] == 0 else mix((bins[(k + near[0]) % 32] + near[0]) & M)
            row.append(max(1, v & 0xFFFF) if near else 0)
        out += row
    return out


def test_fingerprints_by_brute_force():
    rng = np.random.default_rng(5)
    texts = ["", "a", "ab", "aaaa", "abab" * 9, "\U0001f642x" * 7, *("".join(rng.choice(list("abcdefgh \u00e9"), int(n))) for n in (3, 10, 40, 200, 900))]
    got = phrase_prints.prints(texts)
    want = [brute_prints(t) for t in texts]
    assert got.tolist() == want
    same = lambda a, b: sum(w * sum(x == y > 0 for x, y in zip(a[32 * k : 32 * k + 32], b[32 * k : 32 * k + 32], strict=True)) / 32 for k, w in enumerate((0.1, 0.3, 0.3, 0.3)))
    for a, b, p, q in zip(want, want[1:], got, got[1:], strict=False):
        j = same(a, b)
        assert np.isclose(phrase_prints.likeness(p[None], q[None])[0], min(1, 2 * j / (1 + j)))


def test_equal_substrings_share_phrases():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcdefgh "), 3000))
    a, b, c = phrase_prints.prints([text, "prefix of another length" + text, "".join(rng.choice(list("abcdefgh "), 3000))])
    assert phrase_prints.likeness(a[None], b[None])[0] > 0.9 > 0.3 > phrase_prints.likeness(a[None], c[None])[0]


def brute_mix(rows):
    """(doc_id, times) of rows (doc_id, text, source) by one sort a source."""
    import math
    from collections import defaultdict

    import regex

    of = defaultdict(list)
    for i, t, s in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        weight = 0.05 + 0.95 * (len(regex.findall(r"\p{L}", t)) / max(1, len(t))) * (len(set(words)) / max(1, len(words)))
        u = (int(hashlib.md5(f"mix|{i}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
        of[s].append((-math.log(u) / weight, i, len(words)))
    names = sorted(of)
    total, weight = {s: sum(r[2] for r in of[s]) for s in names}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = {}
    while True:
        rest = [s for s in names if s not in full]
        level = (1.5 * sum(total.values()) - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * total[s]]
        target = full | {s: level * weight[s] for s in rest}
        if not over:
            break
        full |= {s: 2.0 * total[s] for s in over}
    out = []
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        before, left = 0, target[s] - epochs * total[s]
        for _, i, n in sorted(of[s]):
            out.append((i, epochs + (before + n / 2 <= left)))
            before += n
    return out


def test_pipeline_against_brute_force(spark, tokenizer):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    good = line_crf.fit(docs, labels).scores([t for _, t, _ in rows])
    rows = [r for r, s in zip(rows, good, strict=True) if s >= 0.5]
    toxic = zstd_toxicity.fit(docs, labels).scores([t for _, t, _ in rows])
    rows = [r for r, s in zip(rows, toxic, strict=True) if s < 0.3]
    comp, _ = brute_components([r[:2] for r in rows])
    rows = [r for r in rows if comp[r[0]] == r[0]]
    text = {i: t for i, t, _ in rows}
    want = []
    for i, times in brute_mix(rows):
        ids = tokenizer.encode(text[i], add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] * times
    got = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got.collect()) == sorted(want)


def test_pipeline_stages_on_odd_rows(spark):
    """Null, empty, blank and very long texts, null and repeated ids, columns with the names that the stages use."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    fine = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(30).collect()]
    odd = [(9001, None, None, None, None), (9002, "", "en", "web", 0), (9003, " \n\t", "en", None, 3), (None, "no id here", "en", "web", 10), (None, None, None, None, None), (9004, "word " * 60_000, "en", "web", 300_000), (9005, "x" * 200_000, "en", "web", 200_000)]
    rows = fine + fine[:4] + odd + odd[:1]
    extra = "_score score doc _doc src key size ids id label y _gone component_id part head".split()
    d = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)).repartition(3)
    count = lambda df: __import__("collections").Counter(map(tuple, df.collect()))
    whole = count(d)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf)
        empty = stage(spark, d.limit(0), sf)
        assert empty.count() == 0
        if name == "encode":
            assert out.count() == len(rows) and out.where("doc_id in (9001, 9002) and (n_tokens > 0 or size(ids) > 0)").count() == 0
            continue
        assert out.columns == d.columns == empty.columns, name
        got = count(out)
        assert set(got) <= set(whole), name
        if name == "near_dedup":
            assert all(got[r] == n for r, n in whole.items() if r[0] is None or not (r[1] or "").split())
        if name != "mix_sources":
            assert all(n == whole[r] for r, n in got.items()), name
        if name == "toxicity":
            assert all(got[r] == n for r, n in whole.items() if not (r[1] or "").split())
