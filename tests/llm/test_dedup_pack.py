import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecgrid.llm import components as C
from vecgrid.llm import exact_dedup as D
from vecgrid.llm import packing as P
from vecgrid.llm import queries as Q
from vecgrid.llm import simhash as S

from .helpers import ODD_TEXTS, no_docs, odd_docs

SF = "/root/testdata/sf0.001"


# exact dedup


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def test_batch_against_brute_force(spark):
    got = D.dedup_batch(odd_docs(spark), D.new_index_name())
    groups = {}
    for i, t in ODD_TEXTS:
        groups.setdefault(digest(t), []).append(i)
    want = []
    for i, t in ODD_TEXTS:
        ids = groups[digest(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, digest(t), keep, len(ids), i == keep))
    rows = [(r[0], r[1].hex(), *r[2:]) for r in got.select("doc_id", "digest", "keep_id", "group_size", "kept").collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_index_persists_over_batches(spark):
    name = D.new_index_name()
    one = spark.createDataFrame([(10, "a  b"), (11, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a b"), (2, "d"), (3, "d")], "doc_id long, text string")
    assert {tuple(r) for r in D.dedup_batch(one, name).select("doc_id", "keep_id", "kept").collect()} == {(10, 10, True), (11, 11, True)}
    assert {tuple(r) for r in D.dedup_batch(two, name).select("doc_id", "keep_id", "kept").collect()} == {
        (1, 10, False),
        (2, 2, True),
        (3, 2, False),
    }
    index = spark.read.table(name)
    assert index.count() == 3 and index.select("digest").distinct().count() == 3
    assert D.dedup_batch(no_docs(spark), name).count() == 0 and spark.read.table(name).count() == 3
    plan = one.select(D.normalised_digest("text").alias("digest")).repartition(D.BUCKETS, "digest")
    plan = plan.join(spark.read.table(name).hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the index is read in its buckets


def test_index_is_found_by_a_second_session(spark):
    """A catalog that has lost the table, as that of a new session with the same warehouse, registers the folder again."""
    name = D.new_index_name()
    one = spark.createDataFrame([(10, "a  b"), (11, "c")], "doc_id long, text string")
    D.dedup_batch(one, name, buckets=3).collect()
    spark.sql(f"DROP TABLE {name}")
    assert not spark.catalog.tableExists(name) and D.stored_index(spark, name)[1] == 3
    two = spark.createDataFrame([(1, "a b"), (2, "d")], "doc_id long, text string")
    assert {tuple(r) for r in D.dedup_batch(two, name).select("doc_id", "keep_id").collect()} == {(1, 10), (2, 2)}
    assert spark.read.table(name).count() == 3
    assert D.drop_index(spark, name) and D.stored_index(spark, name) is None and not D.drop_index(spark, name)


def test_keep_first(spark):
    kept = D.keep_first(odd_docs(spark), D.new_index_name())
    assert kept.columns == odd_docs(spark).columns
    # the texts of 2 and 3 are equal, those of 1 and 5 too
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 6, 8, 9, 10]
    same = spark.createDataFrame([(7, "x"), (7, "x"), (7, "y")], "doc_id long, text string")
    assert sorted(r.text for r in D.keep_first(same, D.new_index_name()).collect()) == ["x", "y"]
    assert D.keep_first(no_docs(spark), D.new_index_name()).count() == 0


# near dedup


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius=2):
    """Smallest index reachable for each value."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_fingerprint_against_brute_force(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [t for _, t in ODD_TEXTS if t is None or len(t) < 1000]
    texts += [" ".join(rng.choice(["a", "B", "ccc", "é", "Ä"], n)) for n in (1, 2, 3, 4, 50, 600)]
    assert [S.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    monkeypatch.setattr(S, "_SLICE", 7)
    assert [S.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius,segments", [(2, 5), (3, 5), (1, 4), (2, 3), (4, 7)])
def test_links_lose_nothing(spark, radius, segments):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3, 4, 5)]
    values = sorted({int(np.uint64(v).astype(np.int64)) for v in [*map(int, base), *near]})
    got = S.links(spark.createDataFrame([(v,) for v in values], "fp long"), radius, segments)
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}
    assert {tuple(r) for r in got.collect()} == want and want


def test_viable_agrees_with_the_budgets(spark):
    masks = S.segment_masks(5)
    assert sum(masks) == (1 << 64) - 1
    x = masks[2] & -masks[2] | masks[0] & -masks[0]  # a bit in segments 0 and 2
    df = spark.createDataFrame([(x,)], "x long")
    assert [df.select(S.viable(F.col("x"), s)).first()[0] for s in range(5)] == [False, False, False, True, False]


def test_groups_on_odd_rows(spark):
    got = S.near_groups(odd_docs(spark)).collect()
    values = [slow_fingerprint(t) for _, t in ODD_TEXTS]
    root = slow_components(values)
    want = []
    for (i, _), v, r in zip(ODD_TEXTS, values, root, strict=True):
        ids = [j for (j, _), q in zip(ODD_TEXTS, root, strict=True) if q == r and j is not None]
        want.append((i, v, min(ids, default=None)))
    assert sorted(((r[0], r[1] % (1 << 64), r[2]) for r in got), key=str) == sorted(want, key=str)
    assert S.near_groups(no_docs(spark)).count() == 0


def test_op8_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    values = [slow_fingerprint(r.text) for r in docs]
    root = slow_components(values)
    want = [(r.doc_id, f"{v:016x}", docs[k].doc_id) for r, v, k in zip(docs, values, root, strict=True)]
    got = Q.QUERIES["op8_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_representatives(spark):
    docs = spark.createDataFrame(
        [(5, "a b c"), (3, "A B C"), (3, "A B C"), (9, "zz yy xx ww"), (None, "q r s"), (None, "a b c")], "doc_id long, text string"
    )
    assert sorted(r.doc_id or 0 for r in S.keep_representatives(docs).collect()) == [0, 3, 9]
    assert S.keep_representatives(no_docs(spark)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    links = spark.createDataFrame([*path, *star, (300, 300), (201, 200), (200, 201)], "a long, b long")
    got = {r.node: r.root for r in C.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}
    assert C.components(links.limit(0)).count() == 0


# packing


@pytest.fixture(scope="module")
def library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_packing(pieces, texts, library, window=1024):
    """Pieces tile every document and every sequence, and hold the library's ids."""
    want = {i: [*ids, 0] for i, ids in zip(texts, library([t or "" for t in texts.values()]), strict=True)}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and p.doc_tokens == len(want[p.doc_id])
        assert p.length > 0
    for doc, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert sum(p.length for p in own) == len(want[doc])
    assert set(by_doc) == set(want)
    full = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        full += sum(p.length for p in own) == window
    assert full >= len(by_sequence) - 1 and sorted(by_sequence) == list(range(len(by_sequence)))


def test_op9_against_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check_packing(Q.QUERIES["op9_packing"](spark, SF).collect(), {r.doc_id: r.text for r in docs}, library)


def test_packing_odd_rows(spark, library):
    texts = {k: t for k, (_, t) in enumerate(ODD_TEXTS)}
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, ids string, part int")
    pieces = P.pack(docs.repartition(3), Q.byte_encoder(), window=16).collect()
    check_packing(pieces, texts, library, 16)
    assert all(zlib.crc32(np.array(p.ids, "<i4").tobytes()) == p.ids_crc32 for p in pieces)
    assert P.pack(no_docs(spark), Q.byte_encoder()).count() == 0
    nameless = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert P.pack(nameless, Q.byte_encoder(), with_ids=False).count() == 2


def test_encoder_on_white_space(library):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    alphabet = list("ab the's 'll12²Ⅳ \t\n\r\x0b\x1c\x85\xa0  　é日😀!?.-<|endoftext|>")
    texts = ["", " ", "  ", "\n\n", "a\n \nb", " a", "a ", "a\n b"]
    texts += ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 40, 2000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in Q.byte_encoder()()(pa.array(texts))]
    assert got == library(texts)


def test_added_tokens_as_the_library_has_them(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  c ", " <|endoftext|>\n x", "<|endoftext|", "plain text", ""]
    rng = np.random.default_rng(2)
    texts += ["".join(rng.choice(["<|endoftext|>", "<|", "endoftext", "|>", " ", "  ", "\n", "the", "é"], n)) for n in rng.integers(0, 12, 500)]
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert want[0].ids == [3826, 220, 50256, 994]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pieces = P.pack(docs, Q.byte_encoder(added=True), window=16).collect()
    check_packing(pieces, dict(enumerate(texts)), lambda t: [e.ids for e in want], 16)


def test_op9_on_a_table_with_added_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "see <|endoftext|> here")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (piece,) = Q.QUERIES["op9_packing"](spark, str(tmp_path)).collect()
    assert piece.doc_tokens == 5 and piece.ids_crc32 == zlib.crc32(np.array([3826, 220, 50256, 994, 0], "<u4").tobytes())
