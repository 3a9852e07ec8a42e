import hashlib
import math
from base64 import b32encode

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecgrid.llm import html_extract as H
from vecgrid.llm import queries as Q
from vecgrid.llm import shingle_join as J
from vecgrid.llm import vector_search as V
from vecgrid.llm import warc as W
from vecgrid.session import scratch_path

from .helpers import no_docs, odd_docs
from .test_dedup_pack import check_packing, digest, library, slow_components, slow_fingerprint  # noqa: F401

SF = "/root/testdata/sf0.001"


# WARC

PAGES = [
    (1, "http://a/", "<p>one</p>"),
    (2, None, None),
    (3, "http://b/\r\nX-Bad: 1", ""),
    (4, "http://c/", "<p>one</p>"),
    (5, "http://d/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "http://e/", "é日😀" * 5000 + "\n\r\n"),
    (7, "http://f/", "\n"),
    (4, "http://c/", "<p>one</p>"),
    (None, "http://g/", "nameless"),
    (9, "http://h/", "x" * 300),
]


def odd_pages(spark):
    rows = [(*r, "c", 1, "d") for r in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, value string, _part int, digest string")


def sha(text):
    return b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def want_records(pages, least=0):
    out = []
    for i, _, html in pages:
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        first = max(same, default=None)
        revisit = first is not None and i != first and len((html or "").encode()) >= least
        out.append((i, len((html or "").encode()), sha(html), "revisit" if revisit else "response", first if revisit else None))
    return out


@pytest.mark.parametrize("segment,chunk,least", [(1 << 20, 1 << 16, 0), (7, 3, 0), (1000, 64, 5), (64, 1000, 0)])
def test_round_trip(spark, segment, chunk, least):
    path = scratch_path(spark, "warc-test")
    W.write(odd_pages(spark).repartition(2), path, min_bytes=least, segment_bytes=segment)
    chunks = W.read(spark, path, chunk).persist()
    got = [
        (int(r.record_id) if r.record_id else None, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to))
        for r in W.records(chunks).collect()
    ]
    assert sorted(got, key=str) == sorted(want_records(PAGES, least), key=str)
    assert all(r.intact in (True, None) for r in W.records(chunks).collect())
    parts = {}
    for r in chunks.filter("record_type = 'response' AND record_id IN ('5', '6', '7', '9')").collect():
        assert len(r.chunk) <= chunk
        parts.setdefault(r.record_id, []).append((r.chunk_no, r.chunk, r.bytes_so_far, r.last))
    for i, own in parts.items():
        own.sort()
        assert [p[0] for p in own] == list(range(len(own))) and [p[3] for p in own] == [False] * (len(own) - 1) + [True]
        assert [p[2] for p in own] == np.cumsum([len(p[1]) for p in own]).tolist()
        assert b"".join(p[1] for p in own).decode() == next(h for j, _, h in PAGES if str(j) == i)
    uris = {r.record_id: r.target_uri for r in chunks.collect()}
    assert uris["1"] == "http://a/" and uris["2"] is None and uris["3"] == "http://b/  X-Bad: 1"


def test_no_pages(spark):
    path = scratch_path(spark, "warc-test")
    W.write(odd_pages(spark).limit(0), path)
    assert W.read(spark, path).count() == 0


def test_standard_layout(spark):
    """Bytes of an archive: records as the standard has them."""
    path = scratch_path(spark, "warc-test")
    W.write(spark.createDataFrame([(1, "http://a/", "abcdef")], "page_id long, url string, html string"), path, segment_bytes=4)
    raw = b"".join(bytes(r.v) + b"\n" for r in spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("v")).collect())
    records = [r for r in raw.split(b"WARC/1.1\r\n") if r]
    assert len(records) == 2
    for k, r in enumerate(records):
        head, _, rest = r.partition(b"\r\n\r\n")
        headers = dict(line.split(b": ", 1) for line in head.split(b"\r\n"))
        size = int(headers[b"Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n" and headers[b"WARC-Segment-Number"] == str(k + 1).encode()
        assert rest[:size].endswith([b"\r\n\r\nabcd", b"ef"][k])
    assert headers[b"WARC-Type"] == b"continuation" and headers[b"WARC-Segment-Origin-ID"] == b"<urn:record:1>"


# HTML


@pytest.fixture(scope="module")
def page_model():
    return H.fit(H.layouts(250), epochs=150)


def test_messages_against_enumeration():
    rng = np.random.default_rng(3)
    tree = H.parse("<div class=a><p>x y<p>z<ul><li>q<li>r</ul></div><p>end")
    weights = rng.normal(size=H.FEATURES)
    model = H.TreeModel(weights, rng.normal(size=(2, 2, 2)))
    f = H.forest([tree])
    n = len(tree.parent)
    unary = np.bincount(f.of_node, weights[f.feature], n)
    total, ones, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for state in range(1 << n):
        y = [state >> v & 1 for v in range(n)]
        e = sum(unary[v] * y[v] for v in range(n)) + sum(model.edges[f.kind[v], y[tree.parent[v]], y[v]] for v in range(1, n))
        w = math.exp(e)
        total += w
        ones += w * np.array(y)
        for v in range(1, n):
            pairs[v, y[tree.parent[v]], y[v]] += w
    p, joint = H.messages(f, model)
    assert np.allclose(p, ones / total) and np.allclose(joint[1:], pairs[1:] / total)


def test_held_out_layouts(page_model):
    test = H.layouts(100, seed=77)
    f = H.forest([t for t, _ in test])
    p, _ = H.messages(f, page_model)
    y, run = np.concatenate([labels for _, labels in test]), f.kind == 1
    assert ((p >= 0.5) == y)[run].mean() > 0.93


def test_article_without_its_surroundings(page_model):
    page = """<html><head><title>t</title><style>p{}</style></head><body><div class=cookie-notice>We use cookies.
    <button>OK</button></div><header><h1>Site</h1><nav><a href=/>Home</a> <a href=/b>B</a></nav></header><main><article>
    <h1>Headline of things</h1><p>First paragraph with <a href=x>a link</a> &amp; more
    text&nbsp;that is <b>long</b> enough.</p><script>var t="</p>";</script><div class="advert">Buy now! Great offers.</div>
    <p>Second one is a sentence too, with words.</p></article><section class="comments"><h2>Comments</h2><div class="comment"><p>Great article, I loved
    it.</p></div></section></main><div id="sidebar"><ul><li><a>One</a></li></ul></div><footer>c 2020</footer></body></html>"""
    want = "Headline of things\n\nFirst paragraph with a link & more text that is long enough.\n\nSecond one is a sentence too, with words."
    assert H.extract_texts([page], page_model) == [want]


def test_parser():
    runs = lambda page: [t for t in H.parse(page).text if t is not None]
    assert runs("<p>a<br>b  c<p>d<b>e</b>f") == ["a b c", "def"]
    assert runs('<a title="x > y">q</a><!-- <p>no --><script>if (a<b) "</p>"</script >z') == ["qz"]
    assert runs("<ul><li>1<ul><li>2</ul><li>3</ul>&lt;p&gt; &#233;&nbsp;x") == ["1", "2", "3", "<p> é x"]
    assert runs("<script>never ends") == [] and runs("a < b <") == ["a < b <"] and runs('<p class="x') != None  # noqa: E711
    tree = H.parse("<ul><li>1<li>2</ul><table><tr><td>3<td>4<tr><td>5</table>")
    assert [tree.tag[tree.parent[v]] for v, t in enumerate(tree.text) if t] == ["li", "li", "td", "td", "td"]
    assert max(H.parse("<div>" * 5000 + "x").depth) == 5001


def test_op4_against_the_article_element(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    want = {}
    for r in pages:
        tree = H.parse(r.html)
        inside = [False] * len(tree.parent)
        for v in range(1, len(inside)):
            inside[v] = tree.tag[v] == "article" or inside[tree.parent[v]]
        want[r.page_id] = "\n\n".join(t for v, t in enumerate(tree.text) if t is not None and inside[v])
    got = Q.QUERIES["op4_html_extraction"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert sum(r.text == want[r.page_id] for r in got) >= 0.99 * len(got)


def test_pages_odd_rows(spark, page_model):
    rows = odd_pages(spark).select("page_id", H.extractor(page_model)("html").alias("r")).collect()
    assert len(rows) == len(PAGES) and rows[1].r.text == rows[2].r.text == ""
    assert odd_pages(spark).limit(0).select(H.extractor(page_model)("html").alias("r")).count() == 0
    assert H.labelled_sample(odd_pages(spark)) == []
    assert H.extract_texts(["<p>some words.</p>"], H.fit([])) == ["some words."]


# search


def brute(rows, k, is_query):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault((i, tuple(math.floor(64 * x) for x in v)))
    out = []
    for qi, q in usable:
        if is_query(qi):
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in usable if i != qi and len(v) == len(q))
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec int, block int"


@pytest.mark.parametrize("block_rows,query_rows,sample", [(8192, 512, 4096), (16, 4, 8)])
def test_top_k_against_brute_force(spark, block_rows, query_rows, sample):
    rng = np.random.default_rng(5)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32(rng.normal(size=16) * rng.choice([0.1, 1, 3]))) for i in range(150)]
    same = f32(rng.normal(size=16) * 3)
    rows += [(i, same) for i in range(200, 280)]  # a hot vector with many more ids than k
    rows += [(i, f32(rng.integers(-1, 2, 16))) for i in range(300, 360)]  # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (404, []), (420, [])]
    rows += [(440, [1.0, 2.0]), (441, [3.0, -1.0]), (None, same), (200, same), (460, [1e12, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA).repartition(3)
    got = V.top_k(df, F.col("vec_id") % 20 == 0, 5, block_rows=block_rows, query_rows=query_rows, sample=sample)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows, 5, lambda i: i % 20 == 0)


def test_top_k_no_rows(spark):
    assert V.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0], 1, "x", 2, 3)], SCHEMA)
    assert V.top_k(one, F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 64)) * 20
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 64)))
    q = x[::50]
    exact = q @ x.T
    for s in V.LEVELS:
        assert (V.segment_statistics(q, s) @ V.segment_statistics(x, s).T >= exact - 1e-6).all()
    least = -np.sort(-exact, axis=1)[:, 20]
    a, b, score, left = V.survivors(q, x, least)
    want = np.argwhere(exact >= least[:, None])
    assert (np.stack([a, b], 1) == want).all() and (score == exact[a, b]).all()
    assert left == sorted(left, reverse=True) and left[-1] < exact.size / 4


# pipeline


def test_pipeline_against_brute_force(spark, library):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        before = spark.createDataFrame(after.collect(), docs.schema)
        if name == "language_id":
            clean = before.collect()
    first = {}
    for r in sorted(clean, key=lambda r: r.doc_id):
        first.setdefault(digest(r.text), r)
    kept = sorted(first.values(), key=lambda r: r.doc_id)
    root = slow_groups(slow_sets([r.text for r in kept]))
    want = {r.doc_id: r.text for k, r in enumerate(kept) if root[k] == k}
    assert {r.doc_id for r in before.collect()} == set(want)
    check_packing(corpus_pipeline.run(spark, SF).collect(), want, library)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    clean_ids = {r.doc_id for r in clean}
    assert len(clean_ids & toxic) < 0.5 * len(toxic) and len(clean_ids) > 0.7 * docs.count()


def test_stages_on_odd_and_no_rows(spark):
    for docs in (odd_docs(spark), no_docs(spark)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns and got.count() <= n
        assert (corpus_pipeline.pack_sequences(spark, docs, SF).count() > 0) == (n > 0)


def near_copies():
    """Texts of which some differ in a word or a few, some only by chains of such copies, and all share a passage."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(500)]
    passage = " ".join(rng.choice(words, 30))
    texts = []
    for _ in range(12):
        base = list(rng.choice(words, int(rng.integers(20, 300))))
        for n in (0, 1, 1, 2, 4, 8):
            own = list(base)
            for at in rng.integers(0, len(own), n):
                own[at] = str(rng.choice(words))
            texts.append(" ".join(own) + " " + passage)
            base = own if n == 1 else base
    return texts + ["a b", "A  b", "a b c d e", "", None]


def slow_sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def slow_groups(sets, least=0.8):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a | b and 10 * len(a & b) >= round(10 * least) * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def test_near_dedup_stage_against_brute_force_jaccard(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = slow_groups(slow_sets(texts))
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = sorted(r.doc_id for r in stage(spark, docs, SF).collect())
    assert kept == sorted(set(want)) and len(kept) < len(texts) - 20
    got = {r.doc_id: r.component_id for r in J.near_groups(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want


@pytest.mark.parametrize("shingle,least", [(5, 0.5), (2, 0.9), (5, 1.0)])
def test_near_groups_by_other_bounds(spark, shingle, least):
    texts = [t for t in near_copies() if shingle == 5 or t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set() for w in words]
    got = {r.doc_id: r.component_id for r in J.near_groups(docs, shingle=shingle, similarity=least).collect()}
    assert [got[k] for k in range(len(texts))] == slow_groups(sets, least)


def test_near_groups_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = slow_groups(slow_sets([r.text for r in rows]))
    got = {r.doc_id: r.component_id for r in J.near_groups(spark.createDataFrame(rows)).collect()}
    assert [got[r.doc_id] for r in rows] == [rows[k].doc_id for k in want]


def test_parser_keeps_the_rest_of_the_page():
    runs = lambda page: [t for t in H.parse(page).text if t is not None]
    for tag in ("select", "svg", "template", "noscript", "iframe", "video", "audio", "canvas", "object", "math"):
        assert runs(f"<{tag} class=x><article><p>kept</p></article>") == ["kept"], tag
    assert runs("<select><option>1</select><p>a<select><p>b<select><option>2</select>c") == ["a", "bc"]
    assert runs("<p>a<svg><svg><text>no</text></svg>no</svg>b<!-- <svg> --><svg/>c") == ["abc"]
    assert runs("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then <object>fallback</object>") == ["if x=1 then fallback"]
    assert runs("<p>a<style>never <p>ends") == ["a"]
    tree = H.parse(f'<div class="{"flex-1 " * 60}sidebar"><p>x</div>')
    assert "sidebar" in tree.names[1]
