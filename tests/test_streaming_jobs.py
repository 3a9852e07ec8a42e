import numpy as np
import pytest
from pyspark.sql import functions as F

from vecgrid.operators import grid as G
from vecgrid.operators import reduce as R
from vecgrid.operators import sketches as S
from vecgrid.plans import jobs as J
from vecgrid.sources.chunks import assign_chunk_id
from vecgrid.streaming import incremental as I


@pytest.fixture
def arriving(table, tmp_path):
    """Events and vectors as four files each."""
    for name, key in (("events", "event_id"), ("embeddings", "vec_id")):
        table(name).repartition(4, key).write.parquet(f"{tmp_path}/{name}")
    return tmp_path


def test_project_stream_equals_batch(spark, table, arriving):
    vecs = table("embeddings")
    model = R.pca_fit(vecs, "embedding", 64)
    stream = I.file_stream(spark, f"{arriving}/embeddings", vecs.schema, max_files=1)
    for _ in range(2):  # the second run finds nothing new
        I.project_stream(stream, model, f"{arriving}/out", f"{arriving}/cp", "embedding").awaitTermination()
    got = spark.read.parquet(f"{arriving}/out").orderBy("vec_id").toPandas()
    want = R.pca_transform(vecs, "embedding", model).orderBy("vec_id").toPandas()
    assert list(got.vec_id) == list(want.vec_id)
    np.testing.assert_allclose(got.PCA_1, want.PCA_1)


def test_moments_and_sketch_streams_equal_batch(spark, table, arriving):
    vecs, events = table("embeddings"), table("events")
    stream = I.file_stream(spark, f"{arriving}/embeddings", vecs.schema, max_files=1)
    I.moments_stream(stream, f"{arriving}/mom", f"{arriving}/cp1", "embedding", 64).awaitTermination()
    got = R.fit_from_moments(I.read_moments(spark, f"{arriving}/mom"))
    want = R.pca_fit(vecs, "embedding", 64)
    assert got.n == want.n
    np.testing.assert_allclose(got.explained_variance, want.explained_variance, rtol=1e-9)

    ev = I.file_stream(spark, f"{arriving}/events", events.schema, max_files=1)
    for _ in range(2):
        I.sketch_stream(ev, f"{arriving}/sk", f"{arriving}/cp2", ["value"], ["event_type"]).awaitTermination()
    merged = S.merge(I.read_sketches(spark, f"{arriving}/sk", ["value"], ["event_type"]), ["value"])
    row = S.read_quantiles(merged, ["value"], [0.0, 0.5, 1.0]).first()
    vals = np.sort(events.toPandas().value.to_numpy())
    assert row.value_n == len(vals) and (row.value[0], row.value[2]) == (vals[0], vals[-1])
    assert abs(np.searchsorted(vals, row.value[1]) / len(vals) - 0.5) < 0.005


def test_assign_stream_equals_batch(spark, table, arriving):
    events = table("events")
    model = G.fit_grid(events, [("value", 5), ("user_id", 4)], "exact")
    stream = I.file_stream(spark, f"{arriving}/events", events.schema, max_files=2)
    I.assign_stream(stream, model, f"{arriving}/bins", f"{arriving}/cp3").awaitTermination()
    got = {(r.event_id, r.cluster_id) for r in spark.read.parquet(f"{arriving}/bins").collect()}
    want = G.apply_grid(events, model).withColumn("c", G.encode_cell(model.bin_columns, model.sizes))
    assert got == {(r.event_id, r.c) for r in want.collect()}


def test_resume_skips_finished_and_hides_interrupted(spark, table, tmp_path):
    orders = table("orders").select("o_orderkey", F.lit("orders").alias("_source"))
    chunked = assign_chunk_id(orders, 4000, ["o_orderkey"])
    out, manifest = f"{tmp_path}/out", f"{tmp_path}/manifest"
    assert J.process_pending(chunked.filter("chunk_id < 2"), lambda d: d, out, manifest) == 2

    def crash(d):
        d.write.parquet(f"{out}/run=broken")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        J.process_pending(chunked, crash, out, manifest)
    assert J.read_finished(spark, out, manifest).count() == 8000
    assert J.process_pending(chunked, lambda d: d, out, manifest) == 2
    assert J.process_pending(chunked, lambda d: d, out, manifest) == 0
    done = J.read_finished(spark, out, manifest)
    assert done.count() == done.select("o_orderkey").distinct().count() == 15000


def test_three_jobs_end_to_end(spark, table, tmp_path):
    docs = table("documents").select("doc_id", F.col("text").alias("smiles"))
    coords, model = J.vectors_job(docs, 12, kind="mqn", patterns="text")
    assert model.n == 1000 and coords.columns == ["doc_id", "smiles", "PCA_1", "PCA_2", "PCA_3"]
    cells = J.cells_job(coords, f"{tmp_path}/cells", (3, 3, 3))
    counts = G.cell_counts(cells).toPandas()
    assert counts.n_rows.sum() == 1000 and len(counts) == 27
    nodes, edges = J.map_job(cells, sizes=(3, 3, 3), id_col="doc_id", permutations=32, trees=4, k=4)
    assert nodes.count() == 27 and edges.count() <= 26
    nodes, _ = J.map_job(cells, "1_2_0", (3, 3, 3), id_col="doc_id", permutations=32, trees=4, k=4)
    assert nodes.count() == counts[counts.cluster_id == 15].n_rows.iloc[0]
    again, same = J.vectors_job(docs, 12, kind="mqn", patterns="text", model=model)
    assert same is model and again.count() == 1000
