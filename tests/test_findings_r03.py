import numpy as np
import pytest
from pyspark.sql import functions as F

from test_maps import kruskal
from vecgrid.functions import features as X
from vecgrid.operators import neighbours as N
from vecgrid.operators.forest import spanning_forest
from vecgrid.plans.queries import QUERIES


def test_streams_read_a_table_that_is_a_folder_of_files(spark, table, tmp_path):
    vecs = table("embeddings").limit(120)
    vecs.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["stream_project"](spark, str(tmp_path)).count() == 120
    n = QUERIES["stream_moments"](spark, str(tmp_path)).count()
    assert n == 64 * 64


def test_best_of_groups_equals_all_pairs_and_leaves_k_rows_a_node(spark):
    """Groups of all sizes, among them one over several Arrow batches' worth of boundaries."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for group, size in enumerate([1, 2, 2, 3, 7, 40, 40, 130]):
        sigs = rng.integers(0, 4, (size, 8))
        ids = sorted(int(i) for i in rng.permutation(1000)[:size])
        rows += [(0, group, 0, i, s.tolist()) for i, s in zip(ids, sigs, strict=True)]
        for i, s in zip(ids, sigs, strict=True):
            others = sorted((-int((s == t).sum()), j) for j, t in zip(ids, sigs, strict=True) if j != i)
            want[group, i] = {o for o in others[:4] if o[0] < 0}
    df = spark.createDataFrame(rows, "tree int, head int, piece long, id long, sig array<int>")
    for group in range(8):
        got = {r.src: [tuple(n) for n in r.near] for r in N._best_of_groups(df.filter(F.col("head") == group), 4).collect()}
        assert all(len(n) <= 4 for n in got.values())
        assert {(group, i): set(n) for i, n in got.items() if n} == {k: v for k, v in want.items() if k[0] == group and v}
    whole = N._best_of_groups(df, 4)
    assert sum(len(r.near) for r in whole.collect()) == sum(map(len, want.values()))


@pytest.mark.parametrize("remainder", [0, 60, 10_000])
def test_forest_is_the_same_however_it_ends(spark, remainder):
    rng = np.random.default_rng(4)
    edges = [(f"n{a}", f"n{b}", float(w)) for a, b, w in zip(rng.integers(0, 200, 600), rng.integers(0, 200, 600), rng.integers(0, 3, 600), strict=True)]
    edges += [(f"p{i:03}", f"p{i + 1:03}", 1.0) for i in range(120)]  # one long chain of equal weights
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    assert {tuple(r) for r in spanning_forest(df, remainder).collect()} == kruskal(edges)


def test_blocks_follow_the_spread_of_coordinates(spark):
    """Unlike spreads: a point visits a few blocks, not a whole row of flat ones."""
    rng = np.random.default_rng(6)
    n, k = 6000, 5
    at = np.stack([rng.integers(0, 1_000_000, n) / 100, rng.integers(0, 25, n), rng.integers(0, 97, n)], axis=1)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, a double, b double, c double")
    seen, whole = [], N.visit
    try:
        N.visit = lambda visits, *rest: (seen.append(visits.count()), whole(visits, *rest))[1]
        got = {(r.src, r.dst, r["rank"]) for r in N.knn_coords(df, "id", ["a", "b", "c"], k, 32).collect()}
    finally:
        N.visit = whole
    d2 = sum((at[:, None, i] - at[None, :, i]) ** 2 for i in range(3))
    np.fill_diagonal(d2, np.inf)
    best = np.lexsort((np.broadcast_to(np.arange(n), (n, n)), d2), axis=1)[:, :k]
    assert got == {(i, int(j), r + 1) for i in range(n) for r, j in enumerate(best[i])}
    assert seen[0] <= 8 * n
