import bz2

import pytest
from pyspark.sql import functions as F

from vecgrid.operators.grid import select_cell
from vecgrid.sinks import writers as W
from vecgrid.sources import chunks as C
from vecgrid.sources import readers as R

ROWS = [("1", "CCCCCCCC", "10.5"), ("2", "CCC=O", "8.2"), ("3", "C1=CC=CC=C1", "15.8")]
TEXT = ["CCCCCCCC", "CCC=O", "C1=CC=CC=C1"]


def write(path, rows, sep, header=None):
    lines = ([sep.join(header)] if header else []) + [sep.join(r) for r in rows]
    data = ("\n".join(lines) + "\n").encode()
    path.write_bytes(bz2.compress(data) if path.suffix == ".bz2" else data)
    return str(path)


def strings(df):
    return sorted(r[0] for r in df.select(df.columns[0]).collect())


def test_positional_text_with_and_without_header(spark, tmp_path):
    a = write(tmp_path / "a.txt", ROWS, "\t", ("ID", "SMILES", "Property"))
    b = write(tmp_path / "b.cxsmiles", ROWS, "\t")
    assert strings(R.read_strings(spark, a, col=1)) == sorted(TEXT)
    assert strings(R.read_strings(spark, b, col=1, header=False)) == sorted(TEXT)
    assert strings(R.read_strings(spark, a)) == strings(R.read_strings(spark, a, header=0)) == ["1", "2", "3"]
    assert strings(R.read_strings(spark, b, header=None)) == ["1", "2", "3"]
    with pytest.raises(ValueError, match="first line"):
        R.read_strings(spark, a, header=1)
    with pytest.raises(ValueError, match="no column 7"):
        R.read_strings(spark, a, col=7)


def test_csv_by_name_and_bz2(spark, tmp_path):
    head = ("id", "smiles", "x")
    a = write(tmp_path / "a.csv", ROWS, ",", head)
    b = write(tmp_path / "b.csv.bz2", ROWS, ",", head)
    df = R.read_strings(spark, [a, b])
    assert strings(df) == sorted(TEXT * 2)
    assert df.select("_source").distinct().count() == 2
    with pytest.raises(ValueError, match="id"):
        R.read_strings(spark, a, col="text")
    q = tmp_path / "q.csv"
    q.write_text('smiles,name\n"C,C","a ""b"""\nNA,x\n,y\n')
    assert [r.smiles for r in R.read_strings(spark, str(q)).collect()] == ["C,C", "NA", None]


def test_folder_mixed_formats_and_parquet(spark, tmp_path):
    write(tmp_path / "a.csv", ROWS, ",", ("id", "smiles", "x"))
    spark.createDataFrame([("N",)], "smiles string").write.parquet(str(tmp_path / "p.parquet"))
    (tmp_path / "_SUCCESS").write_text("")
    assert strings(R.read_strings(spark, [str(tmp_path / "a.csv"), str(tmp_path / "p.parquet")])) == sorted([*TEXT, "N"])
    assert strings(R.read_strings(spark, str(tmp_path))) == sorted(TEXT)  # folders inside are not entered


def test_bad_inputs(spark, tmp_path):
    with pytest.raises(ValueError, match="no such file"):
        R.read_strings(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="unsupported"):
        R.read_strings(spark, write(tmp_path / "a.xyz", ROWS, ","))
    with pytest.raises(ValueError, match="path"):
        R.expand_inputs(spark, 7)


def test_file_ledger(spark, tmp_path):
    spark.range(50_000).selectExpr("id", "uuid() AS u").coalesce(1).write.parquet(str(tmp_path / "w"))
    whole = next((tmp_path / "w").glob("*.parquet")).read_bytes()
    spark.range(0).selectExpr("id", "'' AS u").coalesce(1).write.parquet(str(tmp_path / "e"))
    d = tmp_path / "d"
    d.mkdir()
    middle = len(whole) // 2
    given = {
        "whole": whole,
        "empty": next((tmp_path / "e").glob("*.parquet")).read_bytes(),
        "cut": whole[:middle],
        "torn": whole[:middle] + bytes(20_000) + whole[middle + 20_000 :],
        "text": b"not parquet at all",
        "nothing": b"",
    }
    for name, content in given.items():
        (d / f"{name}.parquet").write_bytes(content)
    files = [str(p) for p in d.iterdir()]
    for schema in (None, "id bigint, u string"):
        rows = {r._source.rsplit("/", 1)[1][:-8]: r for r in R.file_ledger(spark, files, schema).collect()}
        want = {"whole": "intact", "empty": "empty", "cut": "unreadable", "torn": "damaged", "text": "unreadable", "nothing": "unreadable"}
        assert {k: r.status for k, r in rows.items()} == want
        assert {k for k, r in rows.items() if r.reason} == {"cut", "torn", "text", "nothing"}
        assert rows["whole"].n_rows == rows["whole"].n_decoded == rows["torn"].n_rows == 50_000 > rows["torn"].n_decoded
        assert all(r.bytes == len(given[k]) and (r.modified or not r.bytes) for k, r in rows.items())
    lost = R.lost_files(spark, files, R.read_parquet_lenient(spark, files, "skip"))
    assert {r._source.rsplit("/", 1)[1] for r in lost.collect()} == {f"{k}.parquet" for k in ("cut", "torn", "text", "nothing")}
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.parquet").write_bytes(b"")
    assert [r.reason for r in R.file_ledger(spark, str(tmp_path / "n"), "id bigint").collect()] == ["no bytes"]


@pytest.mark.parametrize("split", ["700", "128m"])
def test_chunks_by_splits(spark, tmp_path, split):
    for name, n in (("a", 1000), ("b", 1), ("c", 300)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{name}{k}\n" for k in range(n)))
    conf = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "10" if split == "700" else "4m"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        lines = R.read_strings(spark, str(tmp_path), col=0, header=False, position=True)
        assert (lines.select("_block").distinct().count() > 3) == (split == "700")
        out = C.assign_chunk_id_by_splits(lines, 7)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort" not in plan.split("LogicalRDD")[0]
        assert out.columns == [*lines.columns, "chunk_id"]
        rows = [(r.smiles, r.chunk_id) for r in out.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(rows) == sorted((f"{s}{k}", k // 7) for s, n in (("a", 1000), ("b", 1), ("c", 300)) for k in range(n))
    with pytest.raises(ValueError, match="positive"):
        C.assign_chunk_id_by_splits(lines, 0)


def test_lenient_parquet(spark, tmp_path):
    d = tmp_path / "d"
    spark.range(10).coalesce(1).write.parquet(str(d))
    (d / "bad.parquet").write_bytes(b"not parquet at all")
    files = [str(p) for p in d.glob("*.parquet")]
    df = R.read_parquet_lenient(spark, files, "skip")
    assert df.count() == 10
    assert [r._source.rsplit("/", 1)[1] for r in R.lost_files(spark, files, df).collect()] == ["bad.parquet"]
    with pytest.raises(Exception):
        R.read_parquet_lenient(spark, files, "fail").count()
    with pytest.raises(ValueError):
        R.read_parquet_lenient(spark, files, "maybe")


def test_chunks_follow_file_order_and_keep_equal_stems_apart(spark, tmp_path):
    paths = []
    for folder, n in (("x", 25), ("y", 7)):
        (tmp_path / folder).mkdir()
        paths.append(write(tmp_path / folder / "same.csv", [(f"{folder}{i:03d}",) for i in range(n)], ",", ("smiles",)))
    df = R.read_strings(spark, paths, position=True)
    plan = {r._source[-10]: (r.n_rows, r.n_chunks) for r in C.chunk_plan(df, 10).collect()}
    assert plan == {"x": (25, 3), "y": (7, 1)}
    got = {r.smiles: r.chunk_id for r in C.assign_chunk_id(df, 10).collect()}
    assert got == {f"{f}{i:03d}": i // 10 for f, n in (("x", 25), ("y", 7)) for i in range(n)}
    assert df.select(C.source_stem("_source")).distinct().count() == 1
    with pytest.raises(ValueError):
        C.chunk_plan(df, 0)


def test_chunk_of_one_hot_source(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("s"), "id").repartition(6)
    out = C.assign_chunk_id(df, 100, ["id"], ["s"])
    sizes = {(r.s, r.chunk_id): r["count"] for r in out.groupBy("s", "chunk_id").count().collect()}
    assert sizes[("hot", 0)] == 100 and sizes[("hot", 6)] == 66 and sizes[("cold", 3)] == 34


def test_sinks(spark, tmp_path):
    df = spark.range(600).select(
        "id", *[(F.floor(F.col("id") / d) % n).alias(f"cluster_id_{i + 1}") for i, (d, n) in enumerate([(200, 3), (20, 10), (2, 10)])]
    )
    W.write_grid(df, f"{tmp_path}/grid", ["cluster_id_1", "cluster_id_2"])
    back = spark.read.parquet(f"{tmp_path}/grid")
    cell = select_cell(back, "1_4_7")
    assert cell.count() == 2
    assert "PartitionFilters: [isnotnull(cluster_id_1" in cell._jdf.queryExecution().executedPlan().toString()
    W.write_clusters(df.select("id", F.col("id").alias("cluster_id")), f"{tmp_path}/final", cells=600, n=4)
    assert spark.read.parquet(f"{tmp_path}/final").count() == 600
    W.write_csv(df, f"{tmp_path}/csv", partition_by=["cluster_id_1"])
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 600
    W.write_parquet(df, f"{tmp_path}/pq")
    W.write_parquet(df.limit(1), f"{tmp_path}/pq")
    assert spark.read.parquet(f"{tmp_path}/pq").count() == 600
    W.append_parquet(df, f"{tmp_path}/pq")
    assert spark.read.parquet(f"{tmp_path}/pq").count() == 1200
    W.write_small_json(df.limit(3), f"{tmp_path}/js")
    assert spark.read.json(f"{tmp_path}/js").count() == 3


def test_scratch_folders_are_cleared(spark):
    from vecgrid import session

    path = session.scratch_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    held = dict(session._SCRATCH)
    try:
        session._SCRATCH[spark.sparkContext.applicationId] = [path]
        assert session.clear_scratch(spark) == 1 and session.clear_scratch(spark) == 0
    finally:
        session._SCRATCH.update(held)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
