import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vecgrid.llm import queries as Q
from vecgrid.llm import spelling as S

from .helpers import no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def slow_vocabulary(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[S.damaged(run, h) if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_groups(vocab):
    out = []
    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None
    for w, n in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocab[form[w]] if form[w] else None))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_op13_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = rows(Q.QUERIES["op13_spelling_variants"](spark, SF))
    want = slow_groups(slow_vocabulary([tuple(r) for r in docs]))
    assert got == want and sum(r[1] is not None for r in want) > 50 and any(r[2] not in (r[0], r[1]) for r in want)


@pytest.mark.parametrize("k", [1, 2, 8])
def test_groups_of_odd_words(spark, k):
    rng = random.Random(3)
    vocab = {}
    for _ in range(150):
        w = "".join(rng.choice("abcéÿñx") for _ in range(rng.randint(5, 7)))
        vocab[w] = rng.choice([3, 3, 4, 8, 20, 50])
    vocab |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaab": 12, "z" * 3000: 4, "z" * 3001: 9, "z" * 1500 + "y" + "z" * 1500: 5}
    got = rows(S.group_variants(spark.createDataFrame(list(vocab.items()), "word string, n long").repartition(3), k=k))
    assert got == slow_groups(vocab)


def test_odd_and_no_rows(spark):
    docs = odd_docs(spark).unionByName(odd_docs(spark))
    got = rows(S.spelling_variants(docs))
    assert got == slow_groups(slow_vocabulary([(r.doc_id, r.text) for r in docs.collect()])) and got
    assert rows(S.spelling_variants(no_docs(spark))) == []
    assert rows(S.spelling_variants(spark.createDataFrame([(1, None), (2, ""), (3, "12 34")], "doc_id long, text string"))) == []


def test_a_form_must_be_more_frequent(spark):
    with pytest.raises(ValueError):
        S.group_variants(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def test_hashes_that_agree_cost_only_a_comparison(spark):
    """With one symbol all words of a length have one reduced word, and nothing is lost or added."""
    words = ["below", "bellow", "yellow", "elbow", "bowel", "towel"]
    got = S.near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), 1).select("a", "b")
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert {tuple(r) for r in got.collect()} == want and got.filter(F.col("a") >= F.col("b")).isEmpty()
