import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecgrid.llm import bpe_tree as B
from vecgrid.llm import queries as Q

from .helpers import ODD_TEXTS, no_docs, odd_docs

SF = "/root/testdata/sf0.001"
TEXTS = [
    "", "a", " ", "  two  spaces ", "tabs\tand\n\nlines\r\n", "don't you'll WE'VE 'S", "x" * 5000, "ab" * 3000, "naïve ñandú ÿ", "日本語テキスト" * 50,
    "1234567890" * 20, "!!!???...---" * 9, "<|endoftext|>", "   x　", "😀👩‍👩‍👧 \x00\x1f", "antidisestablishmentarianism", "a" * 65_537,
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = B.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return path, ranks, own, public_tokenizers.PATTERN


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_tree_against_the_library(library, monkeypatch, leaf):
    monkeypatch.setattr(B, "LEAF_BYTES", leaf)
    _, ranks, own, _ = library
    tree, rng = B.BytePairTree(ranks), random.Random(leaf)
    for n in [*range(1, 40)] * 15 + [300, 1000]:
        alphabet = rng.choice([b"a", b"ab", b"aetn ", b"\xc3\xa9\xb1 an", bytes(range(256))])
        data = bytes(rng.choices(alphabet, k=n))
        ids = tree.tree(data)
        assert ids == tree._merge_long(data) == tree._merge_here(data)
        assert tree.encode(data) == own._encode_single_piece(data)
        assert tree.decode(np.array(ids)) == data


def test_join_is_a_monoid(library):
    _, ranks, _, _ = library
    tree, rng = B.BytePairTree(ranks), random.Random(4)
    for _ in range(300):
        a, b, c = (bytes(rng.choices(b"aetns ingo\xc3\xb1", k=rng.randint(0, 30))) for _ in range(3))
        x, y, z = map(tree.tree, (a, b, c))
        both = tree.join(tree.join(list(x), list(y)), list(z))
        assert both == tree.join(list(x), tree.join(list(y), list(z))) == tree.merge(a + b + c)
        assert tree.join([], list(x)) == tree.join(list(x), []) == x


def test_tokens_that_no_merges_lead_to():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257}
    tree = B.BytePairTree(ranks)
    assert tree.unreachable == {b"abcd"} and tree.encode(b"abcd") == [257]
    assert tree.encode(b"xabcd") == [120, 256, 99, 100] and tree.encode(b"abcdabcd" * 9) == [256, 99, 100] * 18
    with pytest.raises(ValueError):
        B.BytePairTree({b"a": 0})


@pytest.mark.parametrize("memo", [10, B.MEMO])
def test_texts_against_the_library(library, memo):
    _, ranks, own, pattern = library
    codec = B.TreeCodec(B.BytePairTree(ranks), pattern, memo)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in codec(pa.array([*TEXTS, None]))]
        assert got == [own.encode_ordinary(t) for t in [*TEXTS, ""]]


def check(got, texts, own):
    want = {}
    for i, t in texts:
        ids = own.encode_ordinary(t or "")
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want.setdefault(i, []).append((len(ids), sha(",".join(map(str, ids)).encode()), sha(own.decode_bytes(ids))))
    rows = {}
    for r in got:
        rows.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    assert {k: sorted(v) for k, v in rows.items()} == {k: sorted(v) for k, v in want.items()}


def test_op12_against_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(Q.QUERIES["op12_bpe_tree"](spark, SF).collect(), docs, library[2])


def test_odd_and_no_rows(spark, library):
    path, _, own, pattern = library
    got = B.encode_documents(odd_docs(spark), path, pattern)
    check(got.collect(), ODD_TEXTS, own)
    plain = got.filter("doc_id = 9").select(F.col("decoded").cast("string").alias("t"), F.length("ids").alias("n"), "n_tokens").first()
    assert plain.t == dict(ODD_TEXTS)[9] and plain.n == 4 * plain.n_tokens
    assert B.encode_documents(no_docs(spark), path, pattern).collect() == []
