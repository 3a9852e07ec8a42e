import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vecgrid.llm import ranked_search as R

from .helpers import no_docs, odd_docs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def slow_terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def slow_search(docs, items, k=10):
    """Rows (item, rank, doc, score) by scoring every document in full."""
    bags = [(i, Counter(t)) for i, text in docs if (t := slow_terms(text))]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 10 + (90 * sum(b.values()) * n) // total
            s = 0
            for t in set(slow_terms(text)) & set(b):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                s += w * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def sample(n, seed):
    rng = random.Random(seed)
    common = [f"w{k}" for k in range(300)]
    draw = lambda: " ".join(rng.choices(common, [1 / (k + 1) for k in range(300)], k=rng.choice([1, 5, 30, 200])))
    docs = [(i, draw()) for i in range(n)]
    return docs, [(i, draw() + " ï x") for i in range(12)]


def test_odd_rows_and_queries(spark):
    docs = odd_docs(spark)
    texts = ["the quick FOX", "word", None, "", "...", "日本語 é", "no such-thing ROW", "the the the word end", "the quick FOX"]
    items = [(n if n < 7 else None, t, 3) for n, t in enumerate(texts)]
    queries = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    want = slow_search([(r.doc_id, r.text) for r in docs.collect()], [x[:2] for x in items])
    assert rows(R.top_k(docs, queries)) == want and want
    assert rows(R.top_k(no_docs(spark), queries)) == [] and rows(R.top_k(docs, queries.limit(0))) == []


@pytest.mark.parametrize("shard", [12 << 20, 3000])
def test_against_brute_force(spark, monkeypatch, shard):
    """Small shards, and queries in blocks of five."""
    for name, value in (("SHARD_BYTES", shard), ("QUERY_ROWS", 5)):
        monkeypatch.setattr(R, name, value)
    docs, items = sample(700, 1)
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # ties beyond k
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert rows(R.top_k(df, queries, k=7)) == slow_search(docs, items, 7)


def one_shard(docs):
    number, doc, names = [], [], {}
    for k, (_, text) in enumerate(docs):
        for t in slow_terms(text):
            number.append(names.setdefault(t, len(names)))
            doc.append(k)
    order = {t: k for k, t in enumerate(sorted(names))}
    to_sorted = np.array([order[t] for t in names])
    pairs, tf = np.unique(to_sorted[number] << 32 | np.array(doc), return_counts=True)
    lengths = np.bincount(doc, minlength=len(docs))
    lists = R.build(pairs >> 32, pairs & 0xFFFFFFFF, tf, lengths, len(names))
    row = {
        "ids": pa.scalar([i for i, _ in docs]),
        "lengths": pa.scalar(lengths.astype("<i8").tobytes()),
        "terms": pa.scalar(sorted(names)),
        "df": pa.scalar(np.bincount(pairs >> 32).tolist(), pa.list_(pa.int32())),
        "head": pa.scalar(lists.head.tobytes()),
        "impact": pa.scalar(lists.impact.tobytes()),
        "packed": pa.scalar(lists.packed),
    }
    return R.Shard(row, set(names), len(docs), len(doc)), pairs, tf


def test_blocks_unpack_to_what_was_packed(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    docs, _ = sample(900, 2)
    docs[5] = (5, "w0 " * 70_000)
    shard, pairs, tf = one_shard(docs)
    terms = sorted({t for _, text in docs for t in slow_terms(text)})
    at = 0
    for t in terms:
        doc, value = shard.postings(t)
        n = len(doc)
        assert (doc == (pairs & 0xFFFFFFFF)[at : at + n]).all() and (value == R.impacts(tf[at : at + n], shard.norm[doc])).all()
        a, b = shard.blocks[t]
        assert [int(shard.block_max[k]) for k in range(a, b)] == [int(shard.block(k)[1].max()) for k in range(a, b)]
        at += n
    assert at == len(pairs)


def test_blocks_are_rejected_before_they_are_unpacked(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 8)
    docs, _ = sample(4000, 3)
    docs[1234] = (1234, "rare rarer w0 w1 w2")
    shard, _, _ = one_shard(docs)
    terms = [("rare", 9000), ("rarer", 8000), ("w0", 300), ("w1", 300), ("w2", 200)]
    found, scores = shard.search(terms, 1, 1)
    best = found[np.argmax(scores)]
    assert best == 1234 and shard.n_unpacked < len(shard.head) / 20
