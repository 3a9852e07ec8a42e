"""The three whole jobs, and resumable chunked runs.

    strings -> vectors -> coordinates     vectors_job
    coordinates -> grid cells             cells_job
    one cell or all representatives -> neighbour map   map_job
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrid.functions.features import featurize
from vecgrid.operators import grid
from vecgrid.operators import reduce as red
from vecgrid.operators.maps import build_map
from vecgrid.session import stable

MANIFEST_SCHEMA = "_source string, chunk_id bigint, n_rows bigint, run string"


# ---------------------------------------------------------------- resume


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Finished chunks; empty before the first run."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def pending(df: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("_source", "chunk_id")) -> DataFrame:
    """Rows of chunks that the manifest does not list yet."""
    return df.join(manifest.select(*keys).distinct(), list(keys), "left_anti")


def process_pending(
    df: DataFrame, work: Callable[[DataFrame], DataFrame], out_path: str, manifest_path: str
) -> int:
    """Run ``work`` over the chunks still to do and record them; returns how many.

    Each run writes its own folder and is listed only once that is complete, so
    an interrupted run leaves nothing that ``read_finished`` would see.
    """
    spark = df.sparkSession
    run = uuid.uuid4().hex
    todo = pending(df, read_manifest(spark, manifest_path))
    done = stable(
        todo.groupBy("_source", "chunk_id").agg(F.count("*").alias("n_rows")).withColumn("run", F.lit(run))
    )
    n = done.count()
    if n:
        work(todo).write.parquet(f"{out_path}/run={run}")
        done.write.mode("append").parquet(manifest_path)
    return n


def read_finished(spark: SparkSession, out_path: str, manifest_path: str) -> DataFrame:
    """Output of all completed runs."""
    runs = read_manifest(spark, manifest_path).select("run").distinct()
    return spark.read.parquet(out_path).join(runs, "run", "left_semi").drop("run")


# ---------------------------------------------------------------- whole jobs


def vectors_job(
    df: DataFrame,
    width: int,
    col: str = "smiles",
    kind: str = "mqn",
    k: int = 3,
    model: red.PCAModel | None = None,
    **options,
) -> tuple[DataFrame, red.PCAModel]:
    """Features, PCA fit (unless a model is given), coordinates.

    The features are computed again for the projection rather than stored:
    they are a narrow map over the input, while storing them would write many
    times the input's size. Pass a checkpointed or saved feature table to
    ``reduce`` directly where the encoder is the expensive part.
    """
    vectors = featurize(df, col, kind, "fp", **options)
    model = model or red.pca_fit(vectors, "fp", width, k)
    return red.pca_transform(vectors, "fp", model), model


def cells_job(df: DataFrame, path: str, sizes: Sequence[int] = (50, 50, 50), method: str = "sketch") -> DataFrame:
    """Nested bins of PCA_1..3 and the final table, laid out by cell."""
    return grid.create_clusters(df, [f"PCA_{i + 1}" for i in range(len(sizes))], sizes, path, method)


def map_job(
    clusters: DataFrame,
    label: str | None = None,
    sizes: Sequence[int] = (50, 50, 50),
    id_col: str = "smiles",
    col: str = "smiles",
    coords: Sequence[str] = ("PCA_1", "PCA_2", "PCA_3"),
    by_coords: bool = False,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: of one cell (``label``) or of all cell representatives.

    Neighbours are found by the strings (``kind`` and other options as in ``build_map``), or ``by_coords``. The map of
    representatives links each node to its cell's ``c1_c2_c3`` label, which ``label`` takes in turn.
    """
    if label is not None:
        rows = grid.select_cell(clusters, label, sizes)
    else:
        rows = grid.representatives(clusters, coords, "cluster_id", id_col, [col] if col != id_col else [])
        cell = F.col("cluster_id")
        if dict(rows.dtypes)["cluster_id"] != "string":
            cell = grid.cell_label(grid.decode_cell("cluster_id", sizes))
        rows = rows.withColumn("cluster_id", cell)
        options = {"cat_cols": ["cluster_id"], "link": True} | options
    return build_map(rows, id_col, col, coords=coords if by_coords else None, **options)
