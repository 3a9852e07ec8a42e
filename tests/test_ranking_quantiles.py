import numpy as np
import pytest
from pyspark.sql import functions as F

from vecgrid.operators import quantiles as Q
from vecgrid.operators.ranking import ranked, running_total
from vecgrid.operators.skew import lookup_join


@pytest.fixture(autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 'hot' holds a third of the rows, one value a third of those; some NULL/NaN."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{i % 7}")
        val = 1.5 if i % 9 == 0 else float(rng.normal())
        if i % 101 == 0:
            val = None
        elif i % 103 == 0:
            val = float("nan")
        rows.append((i, key, val))
    rows.append((5000, "empty", None))
    return spark.createDataFrame(rows, "id long, key string, v double").repartition(5)


def test_ranked_matches_row_number(skewed):
    pdf = ranked(skewed, ["v", "id"], ["key"]).toPandas()
    assert len(pdf) == 3001
    src = skewed.toPandas()
    src["rank_key"] = src.v.map(lambda x: (0, 0) if x is None else (1, x))
    for key, part in pdf.groupby("key", dropna=False):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
        vals = part.sort_values("rank").v.dropna().to_numpy()
        assert (np.diff(vals) >= 0).all()


def test_ranked_global(skewed):
    pdf = ranked(skewed, ["id"]).toPandas().sort_values("id")
    assert list(pdf["rank"]) == list(range(1, 3002))


def test_running_total(spark):
    df = spark.range(1, 1001).withColumn("g", F.col("id") % 3).repartition(4)
    pdf = running_total(df, ["id"], "id", ["g"]).toPandas().sort_values("id")
    for _, part in pdf.groupby("g"):
        assert list(part.total) == list(part.id.cumsum())


@pytest.mark.parametrize("method", ["exact_gather", "exact"])
@pytest.mark.parametrize("n_bins", [1, 7, 29])
def test_exact_quantiles(skewed, method, n_bins):
    probs = Q.even_probs(n_bins)
    src = skewed.toPandas()
    src = src[src.v.notna()]
    whole = Q.quantiles(skewed, ["v"], probs, method=method).first()["v"]
    np.testing.assert_allclose(whole, np.percentile(src.v, np.array(probs) * 100), rtol=1e-12, atol=1e-12)
    got = {r["key"]: r["v"] for r in Q.quantiles(skewed, ["v"], probs, ["key"], method).collect()}
    assert got.pop("empty") is None
    for key, vals in got.items():
        part = src[src.key.isna()] if key is None else src[src.key == key]
        np.testing.assert_allclose(vals, np.percentile(part.v, np.array(probs) * 100), rtol=1e-12, atol=1e-12)


def test_exact_sort_two_columns_and_no_rows(spark, skewed):
    df = skewed.withColumn("w", F.col("v") * 2)
    row = Q.quantiles(df, ["v", "w"], [0.25, 0.75], method="exact").first()
    np.testing.assert_allclose(np.array(row["v"]) * 2, row["w"])
    assert Q.quantiles(df.filter("false"), ["v"], [0.5], method="exact").first()["v"] is None


@pytest.mark.parametrize("method,tol", [("sketch", 0.002), ("approx", 0.001)])
def test_approximate_rank_error(table, method, tol):
    df = table("lineitem")
    vals = np.sort(df.select("l_extendedprice").toPandas().l_extendedprice.to_numpy())
    got = Q.quantiles(df, ["l_extendedprice"], Q.even_probs(50), method=method).first()[0]
    assert got[0] == vals[0] and got[-1] == vals[-1]
    rank = np.searchsorted(vals, got) / len(vals)
    assert np.abs(rank - np.linspace(0, 1, 51)).max() < tol


def test_bad_arguments(skewed):
    with pytest.raises(ValueError):
        Q.quantiles(skewed, ["v"], [0.5], method="magic")
    assert Q.even_probs(0) == [0.0, 1.0]


def test_lookup_join(spark):
    rows = spark.range(2000).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100))
    rows = rows.withColumn("k", F.when(F.col("id") % 500 != 1, F.col("k")))
    table = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    out = lookup_join(rows, table, ["k"])
    assert out.columns == ["id", "k", "x"] and out.count() == 2000
    assert {(r.k, r.x) for r in out.collect()} == {(None, None), *((k, 10 * k if k < 90 else None) for k in range(100))}
