"""One test for each finding of round 4."""

from fractions import Fraction

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from test_maps import kruskal
from tests.llm.test_pages_search_pipeline import slow_groups, slow_sets
from vecgrid.llm import ranked_search as R
from vecgrid.llm import shingle_join as J
from vecgrid.llm import simhash as S
from vecgrid.llm import vector_search as V
from vecgrid.operators import forest
from vecgrid.operators import pivots as P


def groups_of_both(texts):
    """Smallest number reachable over Jaccard links and over fingerprints with at most 2 bits of difference."""
    root, prints = slow_groups(slow_sets(texts)), [S.fingerprint(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_f5_the_near_copy_stage_links_fingerprints_too(spark):
    rng = np.random.default_rng(4)
    words, texts = [f"w{k}" for k in range(400)], []
    for _ in range(25):  # texts that differ in a word every twenty or so: some have alike fingerprints, few are alike by five words
        base = list(rng.choice(words, 150))
        texts.append(" ".join(base))
        for n in (4, 6, 8):
            for at in rng.integers(0, len(base), n):
                base[at] = "other"
            texts.append(" ".join(base))
    texts += ["", "one two three", "One two  three"]
    want = groups_of_both(texts)
    assert want != slow_groups(slow_sets(texts))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, r in enumerate(want) if r == k]
    got = {r.doc_id: r.component_id for r in J.near_groups(docs, fingerprints=True).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_f5_no_filter_of_the_near_copy_stage_goes_by_likelihood(spark):
    """Sets that fit by size and parities go on, however far apart their fingerprints lie."""
    names = ["n", "m", "fp", "fq", *J.PARITIES, *[f"other_{c}" for c in J.PARITIES]]
    pair = spark.createDataFrame([(100, 101, 0, -1, *[5] * 16)], ", ".join(f"{x} long" for x in names))
    assert pair.filter(J._may_be_alike(Fraction("0.8"))).count() == 1


def test_f3_no_table_of_nodes_passes_through_the_driver(spark, monkeypatch):
    """Lookups of the forest and of points are merge joins even where the tables look small."""
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(*rng.integers(0, 300, (2, 900)), rng.random(900), strict=True)]
    plans = []

    def seen(old):
        def stable(df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return old(df)

        return stable

    monkeypatch.setattr(forest, "stable", seen(forest.stable))
    got = forest.spanning_forest(spark.createDataFrame(edges, "src long, dst long, weight double"), remainder=0)
    assert {(r.src, r.dst, r.weight) for r in got.collect()} == kruskal(edges)
    assert sum("SortMergeJoin" in p for p in plans) > 2 and not any("BroadcastExchange" in p for p in plans)


def test_f1_no_table_of_vectors_passes_through_the_driver(spark, monkeypatch):
    plans = []

    def seen(df, label, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label, *rest)

    stored = V.stored
    monkeypatch.setattr(V, "stored", seen)
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)]
    out = V.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 5)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 10 * 5 and not any("BroadcastExchange" in p for p in plans)


def test_f2_a_file_of_the_index_holds_one_shard(spark, monkeypatch):
    """Rows are as large as a shard, and Parquet writes and reads rows of a file together."""
    monkeypatch.setattr(R, "SHARD_DOCS", 10)
    docs = spark.createDataFrame([(i, f"word{i % 9} other{i % 4}") for i in range(60)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(R, "spans", lambda texts: ((k, min(10, len(texts) - k)) for k in range(0, len(texts), 10)))
    index = R.index_documents(docs)
    assert index.count() == len(index.inputFiles()) == 6


def test_f4_visits_of_vectors_without_structure_do_not_grow_with_the_table(spark, monkeypatch):
    rng = np.random.default_rng(7)
    at, seen = rng.normal(size=(1200, 24)).astype(np.float32).astype(float), []

    def counted(visits, *rest):
        seen.append(visits.count())
        return visit(visits, *rest)

    visit = P.visit
    monkeypatch.setattr(P, "visit", counted)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(at)], "id long, v array<float>")
    got = {(r.src, r.dst) for r in P.knn_vectors(df, "id", "v", 1, 4, 4).collect()}
    d = ((at[:, None] - at[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == set(enumerate(d.argmin(axis=1).tolist()))
    print("visits", seen)
    assert seen[0] <= len(at) * (P.RINGS + 4)
