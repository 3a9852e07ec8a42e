import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from vecgrid.operators import reduce as R
from vecgrid.operators import sketches as S
from vecgrid.operators import stats


@pytest.fixture(scope="module")
def vectors(table):
    return table("embeddings").repartition(5)


@pytest.fixture(scope="module")
def matrix(vectors):
    pdf = vectors.orderBy("vec_id").toPandas()
    return np.stack(pdf.embedding.to_numpy()).astype(float)


def test_moments_match_numpy(vectors, matrix):
    rows = sorted(R.moments(vectors, "embedding", 64).collect(), key=lambda r: r.dim)
    co = np.array([r.comoments for r in rows])
    np.testing.assert_allclose(co / len(matrix), np.cov(matrix.T, bias=True), atol=1e-12)
    np.testing.assert_allclose(rows[3].means, matrix.mean(axis=0), atol=1e-12)
    assert {r.n for r in rows} == {500}


def test_moments_merge_in_any_order(vectors):
    whole = R.fit_from_moments(R.moments(vectors, "embedding", 64))
    parts = [R.moments(vectors.filter(F.col("vec_id") % 3 == i), "embedding", 64) for i in (2, 0, 1)]
    merged = R.fit_from_moments(R.merge_moments(parts[0].union(parts[1]).union(parts[2])))
    grown = R.fit_from_moments(R.update(parts[0].union(parts[1]), vectors.filter(F.col("vec_id") % 3 == 1), "embedding", 64))
    for other in (merged, grown):
        np.testing.assert_allclose(other.explained_variance, whole.explained_variance, rtol=1e-9)
        np.testing.assert_allclose(np.abs(other.components), np.abs(whole.components), atol=1e-7)


def test_pca_matches_svd_and_ml(vectors, matrix, spark):
    model = R.pca_fit(vectors, "embedding", 64, 3)
    centred = matrix - matrix.mean(axis=0)
    _, sv, vt = np.linalg.svd(centred, full_matrices=False)
    np.testing.assert_allclose(model.explained_variance, sv[:3] ** 2 / (len(matrix) - 1), rtol=1e-9)
    np.testing.assert_allclose(np.abs(model.components), np.abs(vt[:3]), atol=1e-8)
    assert (model.components[np.arange(3), np.abs(model.components).argmax(axis=1)] > 0).all()
    got = R.pca_transform(vectors.select("vec_id", "embedding"), "embedding", model).orderBy("vec_id").toPandas()
    assert list(got.columns) == ["vec_id", "PCA_1", "PCA_2", "PCA_3"]
    np.testing.assert_allclose(got[["PCA_1", "PCA_2", "PCA_3"]].to_numpy(), centred @ model.components.T, atol=1e-10)
    ml = PCA(k=3, inputCol="v", outputCol="p").fit(
        vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    )
    np.testing.assert_allclose(np.abs(ml.pc.toArray().T), np.abs(model.components), atol=1e-8)


def test_unusable_vectors(spark):
    rows = [([1.0, 2.0],), (None,), ([float("nan"), 1.0],), ([3.0, 5.0],), ([2.0, None],), ([0.0, 1.0],), ([1.0],), ([1.0, float("inf")],)]
    df = spark.createDataFrame(rows, "v array<double>")
    model = R.pca_fit(df, "v", 2, 1)
    assert (model.n, model.nulls) == (3, 5)
    out = R.pca_transform(df, "v", model, keep_vector=True).collect()
    assert [r.PCA_1 is None for r in out] == [False, True, True, False, True, False, True, True]
    with pytest.raises(ValueError):
        R.pca_fit(df.filter("false"), "v", 2, 1)
    with pytest.raises(ValueError):  # no vector is three wide
        R.pca_fit(df, "v", 3, 1)
    with pytest.raises(ValueError):
        R.moments(df, "v", 5000)


def test_model_roundtrip_and_summary(vectors, spark, tmp_path):
    model = R.pca_fit(vectors, "embedding", 64, 3)
    R.save_model(spark, model, f"{tmp_path}/m")
    back = R.load_model(spark, f"{tmp_path}/m")
    assert (back.components == model.components).all() and back.n == model.n
    summary = R.pca_summary(spark, back).collect()
    assert [r.component for r in summary] == [1, 2, 3] and 0 < summary[0].explained_variance_ratio < 1
    with pytest.raises(Exception):
        R.load_model(spark, f"{tmp_path}/none")


def test_sketch_build_merge_read(table, spark, tmp_path):
    df = table("lineitem")
    parts = S.build(df, ["l_extendedprice", "l_quantity"], ["l_returnflag"])
    parts.write.parquet(f"{tmp_path}/sk")
    merged = S.merge(spark.read.parquet(f"{tmp_path}/sk"), ["l_extendedprice", "l_quantity"])
    row = S.read_quantiles(merged, ["l_extendedprice", "l_quantity"], [0, 0.5, 1]).first()
    vals = np.sort(df.toPandas().l_extendedprice.to_numpy())
    assert row.l_extendedprice_n == 60000
    assert (row.l_extendedprice[0], row.l_extendedprice[2]) == (vals[0], vals[-1])
    assert abs(np.searchsorted(vals, row.l_extendedprice[1]) / 60000 - 0.5) < 0.002


def test_percentile_profile(table):
    got = S.percentile_profile(table("lineitem"), "l_extendedprice", method="exact").orderBy("percentile").toPandas()
    vals = table("lineitem").toPandas().l_extendedprice
    assert list(got.percentile) == list(range(0, 100, 2))
    np.testing.assert_allclose(got.value, np.percentile(vals, got.percentile))


def test_fences(table, spark):
    part = table("part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    part = part.withColumn("p_size", F.when(F.col("p_partkey") % 100 == 0, 500).otherwise(F.col("p_size")))
    pdf = part.toPandas()
    q1, q3 = np.percentile(pdf.p_size, [25, 75])
    fence = q3 + 1.5 * (q3 - q1)
    got = stats.iqr_upper_fence(part, ["p_size", "p_retailprice"]).first()
    assert abs(got.p_size_fence - fence) < 1e-9
    assert stats.iqr_filter(part, ["p_size"]).count() == (pdf.p_size <= fence).sum() < len(pdf)
    clipped = stats.iqr_clip(part, ["p_size"]).toPandas()
    assert clipped.p_size.max() == fence and len(clipped) == len(pdf)
    by = stats.iqr_filter(part, ["p_size"], ["p_brand"])
    assert 0 < by.count() <= len(pdf)
    gaps = spark.createDataFrame([(1.0,), (2.0,), (None,), (900.0,), (3.0,), (2.0,)], "x double")
    assert stats.iqr_filter(gaps, ["x"]).count() == 5


@pytest.mark.parametrize("seed", range(3))
def test_moments_of_any_split_agree(spark, seed):
    """Far from zero, unevenly split, with empty parts: centring keeps the digits."""
    rng = np.random.default_rng(seed)
    x = rng.normal(1e6, 1.0, (400, 5))
    part = rng.integers(0, 4, 400) ** 2
    rows = [(int(p), [float(v) for v in r]) for p, r in zip(part, x, strict=True)]
    df = spark.createDataFrame(rows, "p int, v array<double>").repartition(7, "p")
    got = sorted(R.moments(df, "v", 5, max_partials=seed + 1).collect(), key=lambda r: r.dim)
    want = np.cov(x.T, bias=True)
    np.testing.assert_allclose(np.array([r.comoments for r in got]) / 400, want, rtol=1e-7, atol=1e-9)
