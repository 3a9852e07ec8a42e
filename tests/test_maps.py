import numpy as np
import pytest
from pyspark.sql import functions as F

from vecgrid.functions.features import minhash
from vecgrid.operators import maps as M
from vecgrid.operators import neighbours as N
from vecgrid.operators import pivots as P
from vecgrid.operators.forest import spanning_forest
from vecgrid.plans import jobs


def kruskal(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    best = {}
    for a, b, w in edges:
        if a != b:
            key = (min(a, b), max(a, b))
            best[key] = min(w, best.get(key, w))
    out = set()
    for (a, b), w in sorted(best.items(), key=lambda e: (e[1], e[0])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.add((a, b, w))
    return out


@pytest.mark.parametrize("shape", ["random", "path", "star", "empty"])
def test_forest_equals_kruskal(spark, shape):
    rng = np.random.default_rng(3)
    if shape == "random":
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 300, 700), rng.integers(0, 300, 700), rng.integers(0, 5, 700), strict=True)]
    elif shape == "path":
        edges = [(i, i + 1, float(i)) for i in range(200)]
    elif shape == "star":
        edges = [(0, i, 1.0) for i in range(1, 150)] + [(i, i + 1, 1.0) for i in range(1, 140)]
    else:
        edges = []
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = {tuple(r) for r in spanning_forest(df).collect()}
    assert got == kruskal(edges)


def test_forest_with_hot_labels(spark):
    edges = [(0, i, float(i % 3)) for i in range(1, 60)] + [(i, (i * 7) % 60, 0.5) for i in range(60)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    assert {tuple(r) for r in spanning_forest(df).collect()} == kruskal(edges)


def brute_knn(ids, at, k):
    out = set()
    for i, p in zip(ids, at, strict=True):
        d = sorted((float(((p - q) ** 2).sum()), j) for j, q in zip(ids, at, strict=True) if j != i)
        out |= {(i, j, round(x**0.5, 9), r + 1) for r, (x, j) in enumerate(d[:k])}
    return out


@pytest.mark.parametrize("k,block_rows", [(3, 16), (5, 10_000), (7, 40)])
def test_knn_coords_is_exact_with_copies_and_ties(spark, k, block_rows):
    rng = np.random.default_rng(5)
    at = rng.integers(0, 12, (400, 3)).astype(float)
    at[:130] = [3.0, 3.0, 3.0]  # a third of the rows in one place
    at[130:200, 0] = 7.0
    at[399] = [500.0, -80.0, 3.0]
    ids = [int(i) for i in rng.permutation(400)]
    rows = [(i, *map(float, p)) for i, p in zip(ids, at, strict=True)]
    df = spark.createDataFrame([*rows, (1000, None, 1.0, 1.0)], "id long, a double, b double, c double")
    got = {(r.src, r.dst, round(r.weight, 9), r["rank"]) for r in N.knn_coords(df, "id", ["a", "b", "c"], k, block_rows).collect()}
    assert got == brute_knn(ids, at, k)


def test_knn_coords_string_ids_and_few_rows(spark):
    df = spark.createDataFrame([("x", 0.0), ("y", 1.0), ("z", 3.0)], "id string, a double")
    got = {(r.src, r.dst) for r in N.knn_coords(df, "id", ["a"], 5).collect()}
    assert got == {(a, b) for a in "xyz" for b in "xyz" if a != b}


@pytest.mark.parametrize("offset,scale", [(0.0, 1.0), (1e7, 1e-3), (-5.0, 1e6)])
def test_knn_coords_with_clusters_of_all_sizes(spark, offset, scale):
    rng = np.random.default_rng(11)
    parts = [rng.normal(c, w, (n, 2)) for c, w, n in ((0, 1e-4, 200), (3, 1.0, 150), (40, 20.0, 50), (3, 1e-2, 100))]
    at = np.concatenate([*parts, [[900.0, -700.0]]]) * scale + offset
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)], "id long, a double, b double")
    got = {(r.src, r.dst, r["rank"]) for r in N.knn_coords(df, "id", ["a", "b"], 4, 32).collect()}
    assert got == {(i, j, r) for i, j, _, r in brute_knn(range(len(at)), at, 4)}


def wide(spark, ids, at, extra=()):
    return spark.createDataFrame([*((i, [float(v) for v in p]) for i, p in zip(ids, at, strict=True)), *extra], "id long, v array<double>")


@pytest.mark.parametrize("k,pivots,ring_rows", [(3, 1, 16), (5, 8, 24), (4, 64, 10_000)])
def test_knn_vectors_is_exact_with_copies_and_ties(spark, k, pivots, ring_rows):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 5, (6, 20))
    at = centres[rng.integers(0, 6, 420)] + rng.integers(-2, 3, (420, 20))
    at[:140] = at[0]  # a third of the rows in one place
    at[140:200] = at[140] + 0.25 * np.eye(20)[rng.integers(0, 20, 60)]  # many copies and equal distances
    at[419] = 300.0
    ids = [int(i) for i in rng.permutation(420)]
    bad = [(1000, None), (1001, [float("nan")] * 20), (1002, [float("inf")] * 20), (1003, [None] * 20)]
    df = wide(spark, ids, at, bad)
    got = {(r.src, r.dst, round(r.weight, 9), r["rank"]) for r in P.knn_vectors(df, "id", "v", k, pivots, ring_rows).collect()}
    assert got == brute_knn(ids, at, k)


def test_knn_vectors_far_from_the_origin_and_small_tables(spark):
    rng = np.random.default_rng(8)
    at = rng.normal(0, 1e-2, (120, 8)) + 1e6
    got = {(r.src, r.dst, r["rank"]) for r in P.knn_vectors(wide(spark, range(120), at), "id", "v", 3, 4, 16).collect()}
    assert got == {(i, j, r) for i, j, _, r in brute_knn(range(120), at, 3)}
    few = wide(spark, range(3), [[0.0, 1.0], [2.0, 0.0], [9.0, 9.0]])
    assert {(r.src, r.dst) for r in P.knn_vectors(few, "id", "v", 5).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert P.knn_vectors(few.limit(0), "id", "v", 5).count() == 0
    assert N.knn_coords(spark.createDataFrame([], "id long, a double"), "id", ["a"], 5).count() == 0
    with pytest.raises(ValueError, match="width"):
        P.knn_vectors(wide(spark, range(2), [[0.0], [1.0, 2.0]]), "id", "v")


def test_knn_vectors_visits_few_rings_of_clustered_vectors(spark):
    """200 well-parted groups: with a pivot for each, a point meets a small part of all rings."""
    rng = np.random.default_rng(9)
    at = np.repeat(rng.normal(0, 10, (50, 32)), 40, axis=0) + rng.normal(0, 0.1, (2000, 32))
    seen = []
    whole = P.visit
    try:
        P.visit = lambda visits, *rest: (seen.append(visits.count()), whole(visits, *rest))[1]
        got = {(r.src, r.dst, r["rank"]) for r in P.knn_vectors(wide(spark, range(2000), at), "id", "v", 3, 50, 40).collect()}
    finally:
        P.visit = whole
    assert got == {(i, j, r) for i, j, _, r in brute_knn(range(2000), at, 3)}
    assert seen[0] <= 2 * 2000  # of about 50 x 2000


def brute_minhash(sigs, k):
    out = set()
    for i, x in sigs.items():
        found = sorted((-sum(p == q for p, q in zip(x, y, strict=True)), j) for j, y in sigs.items() if j != i)
        out |= {(i, j, -m, r + 1) for r, (m, j) in enumerate(found[:k]) if m < 0}
    return out


@pytest.mark.parametrize("kc", [300, 80])
def test_knn_minhash_is_all_pairs_while_groups_are_small(table, kc):
    docs = table("documents").filter("doc_id < 260").repartition(3)
    signed = minhash(docs.select("doc_id", "text"), "text", "sig", 32, tokenizer="words").drop("text")
    sigs = {r.doc_id: list(r.sig) for r in signed.collect() if r.sig is not None}
    got = N.knn_minhash(signed, "doc_id", "sig", 32, k=4, kc=kc)
    assert {(r.src, r.dst, r.matches, r["rank"]) for r in got.collect()} == brute_minhash(sigs, 4)


def test_knn_minhash_with_a_third_copies(spark):
    text = F.when(F.col("id") % 3 == 0, F.lit("same words in every copy here")).otherwise(
        F.concat_ws(" ", *[F.md5((F.col("id") + i).cast("string")) for i in range(6)])
    )
    signed = minhash(spark.range(600).select("id", text.alias("t")), "t", "sig", 16, shingle=1, tokenizer="words")
    got = N.knn_minhash(signed, "id", "sig", 16, k=5, trees=4).toPandas()
    copies = got[got.src % 3 == 0]
    assert (copies.groupby("src").size() == 5).all() and (copies.matches == 16).all() and len(copies) == 1000
    assert (copies.dst % 3 == 0).all()
    with pytest.raises(ValueError):
        N.knn_minhash(signed, "id", "sig", 32)


@pytest.mark.parametrize("kc,places,firsts", [(100, 1.0, 1.0), (10, 0.9, 0.97)])
def test_knn_sees_past_many_copies_and_repeated_ids(spark, kc, places, firsts):
    """600 near copies of one text, in groups far larger than a piece for the smaller kc, and rows that repeat an id."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1000, 64)
    rows = []
    for i in range(600):
        sig = base.copy()
        sig[rng.choice(64, i % 7, replace=False)] = rng.integers(1000, 2000, i % 7)
        rows.append((i, sig.tolist()))
    df = spark.createDataFrame([*rows, *rows[:50]], "id long, sig array<int>")
    got = N.knn_minhash(df, "id", "sig", 64, k=10, kc=kc).toPandas()
    mat = np.array([s for _, s in rows])
    assert (got.src != got.dst).all() and not got.duplicated(["src", "dst"]).any() and (got.groupby("src").size() == 10).all()
    want = np.array([np.sort((mat == m).sum(axis=1))[::-1][1:11] for m in mat])
    have = got.sort_values(["src", "rank"]).matches.to_numpy().reshape(600, 10)
    assert (have == want).mean() >= places and (have[:, 0] == want[:, 0]).mean() >= firsts


def test_smiles_map_has_edges(spark):
    names = ["CCO", "CCN", "CCC", "CCCC", "CCCO", "c1ccccc1", "c1ccccc1C", "c1ccccc1CC", "CC(=O)O", "CC(=O)OC"]
    df = spark.createDataFrame([(n, float(i), 0.0, 0.0, i % 2) for i, n in enumerate(names)], "smiles string, PCA_1 double, PCA_2 double, PCA_3 double, cluster_id long")
    for options in ({"kind": "mhfp"}, {"kind": "mapc"}, {"by_coords": True}):
        nodes, edges = jobs.map_job(df, sizes=(2, 2, 2), label="0_0_1", k=4, **options)
        assert nodes.count() == 5 and edges.count() > 0, options
    nodes, _ = jobs.map_job(df, sizes=(2, 2, 2), k=4)
    assert sorted(r.label.split("__")[1] for r in nodes.collect()) == [
        f'<a href="/generate/{c}" target="_blank">{c}</a>' for c in ("0_0_0", "0_0_1")
    ]


def test_knn_finds_close_texts(table):
    docs = table("documents")
    signed = minhash(docs.select("doc_id", "text"), "text", "sig", 64, tokenizer="words").drop("text")
    pdf = signed.toPandas()
    sig = np.stack(pdf.sig.to_numpy())
    best = np.array([np.sort((sig[i] == sig).sum(axis=1))[-2] for i in range(len(sig))])
    near = N.knn_minhash(signed, "doc_id", "sig", 64, k=10, trees=8).filter("rank = 1").toPandas()
    got = near.set_index("src").matches.reindex(pdf.doc_id).fillna(0).to_numpy()
    close = best >= 32
    assert close.sum() > 20 and (got[close] == best[close]).mean() > 0.95


def test_labels_codes_properties(spark):
    rows = [("CCO", "b", None), ("c1ccccc1", "a", 2), ("bad!", None, 2)]
    df = spark.createDataFrame(rows, "smiles string, kind string, n int")
    got = [r.label for r in M.node_labels(df, "smiles", ["kind", "n"]).collect()]
    assert got == ["CCO__b__Unknown", "c1ccccc1__a__2", "bad!__Unknown__2"]
    linked = M.node_labels(df.withColumn("kind", F.lit("<x>")), "smiles", ["kind"], link=True).first().label
    assert linked == 'CCO__<a href="/generate/&lt;x&gt;" target="_blank">&lt;x&gt;</a>'
    codes = {r.smiles: r.kind_code for r in M.category_codes(df, "kind").collect()}
    assert codes == {"CCO": 2, "c1ccccc1": 1, "bad!": 0}
    props = {r.smiles: r for r in M.property_columns(df.withColumn("clogP", F.lit(1.5))).collect()}
    assert props["c1ccccc1"].frac_aromatic == 1.0 and props["CCO"].clogp == 1.5 and props["bad!"].hac is None


def test_build_map_both_ways(table):
    docs = table("documents").filter("doc_id < 150")
    nodes, edges = M.build_map(docs, "doc_id", "text", k=5, permutations=32, trees=4, cat_cols=["lang"], tokenizer="words")
    assert nodes.count() == 150 and "lang_code" in nodes.columns
    pairs = [(r.src, r.dst) for r in edges.collect()]
    assert len(kruskal([(a, b, 1.0) for a, b in pairs])) == len(pairs)  # no cycle
    emb = table("embeddings").select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).alias(f"c{i}") for i in range(3)])
    nodes, edges = M.build_map(emb.withColumn("s", F.lit("C")), "id", "s", coords=["c0", "c1", "c2"], k=4)
    assert nodes.count() == 500 and edges.count() <= 499
