"""Exact dedup against a persistent digest index.

The index is a table in the warehouse with one row per digest, bucketed and sorted by the
digest; later sessions find it there. A batch is first reduced to one row per digest (partial aggregation, so a text
that makes up a third of the batch is one row per task), laid out in the same
buckets, and a sort-merge anti-join without any shuffle of the index finds the
digests that are new; those are appended, each task to one bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrid.llm.common import SPACE, sized, stored, text_of

BUCKETS, BUCKET_ROWS = 64, 2_000_000  # least number of buckets of a new index, digests of its first batch in a bucket at most
#: Columns of the index.
DIGEST, KEEP = "digest", "keep_id"


def normalised_digest(text_col: str) -> Column:
    """SHA-256 (binary) of the text in UTF-8 with each run of white space as one space; NULL counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text_col), SPACE, " "), 256))


def new_index_name(label: str = "digest_index") -> str:
    return f"{label}_{uuid.uuid4().hex}"


def stored_index(spark: SparkSession, index: str) -> tuple[str, int] | None:
    """(folder, buckets) of an index that this or an earlier session has written to the warehouse."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(f"{_warehouse(spark)}/{index}.buckets-*")
    found = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hpath)
    folders = [str(f.getPath()) for f in found or []]
    return (folders[0], int(folders[0].rsplit("-", 1)[1])) if folders else None


def _warehouse(spark: SparkSession) -> str:
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def ensure_index(firsts: DataFrame, index: str, buckets: int | None = None) -> int:
    """Make the table ``index`` with the columns of ``firsts``, empty, if there is none; returns its number of buckets.

    The folder's name holds the number of buckets, so a session whose catalog does not know the table registers it again. A new
    index has ``buckets``, or as many as the size of ``firsts`` asks for.
    """
    spark = firsts.sparkSession
    place = stored_index(spark, index)
    if place is None:
        buckets = buckets or max(BUCKETS, -(-firsts.count() // BUCKET_ROWS))
        place = f"{_warehouse(spark)}/{index}.buckets-{buckets}", buckets
    if not spark.catalog.tableExists(index):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in firsts.select(DIGEST, KEEP).schema)
        spark.sql(
            f"CREATE TABLE `{index}` ({columns}) USING parquet CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {place[1]} BUCKETS LOCATION '{place[0]}'"
        )
    return place[1]


def drop_index(spark: SparkSession, index: str) -> bool:
    """Take an index out of the catalog and delete its folder; whether there was one."""
    place = stored_index(spark, index)
    spark.sql(f"DROP TABLE IF EXISTS `{index}`")
    if place:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(place[0])
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
    return place is not None


def append_new(firsts: DataFrame, index: str, buckets: int | None = None) -> None:
    """Append to table ``index`` the rows of ``firsts`` (digest, keep_id; one row per digest) whose digest it lacks."""
    buckets = ensure_index(firsts, index, buckets)
    known = firsts.sparkSession.read.table(index).select(DIGEST)
    # One task per bucket on both sides; the merge hint keeps the planner from broadcasting the index.
    laid_out = firsts.select(DIGEST, KEEP).repartition(buckets, DIGEST)
    fresh = laid_out.join(known.hint("merge"), DIGEST, "left_anti").sortWithinPartitions(DIGEST)
    fresh.write.mode("append").format("parquet").bucketBy(buckets, DIGEST).sortBy(DIGEST).saveAsTable(index)


def dedup_batch(
    docs: DataFrame, index: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None
) -> DataFrame:
    """Deduplicate one batch against the index and add its new digests to it.

    Returns for each row of ``docs`` (id, ``digest`` binary, ``keep_id``, ``group_size`` long,
    ``kept`` boolean). ``keep_id`` is the id that the index holds for the text: that
    of an earlier batch, or the smallest id of this one. ``group_size`` counts this batch.

    NULL text is the empty text, and all empty texts are equal. A row with a NULL id loses
    to any other id; if all ids of a text are NULL, keep_id is NULL and these rows are kept.
    Rows that repeat id and text are both kept if the id wins. An empty batch gives no rows and
    leaves the index as it is. Other columns are never read, whatever their names.
    """
    spark = docs.sparkSession
    rows = stored(docs.select(F.col(id_col).alias("_id"), normalised_digest(text_col).alias(DIGEST)), "dedup-rows")
    groups = stored(
        rows.groupBy(DIGEST).agg(F.min("_id").alias(KEEP), F.count(F.lit(1)).alias("group_size")), "dedup-groups"
    )
    append_new(groups, index, buckets)
    held = spark.read.table(index).select(DIGEST, KEEP)
    sizes = stored(groups.select(DIGEST, "group_size").join(held.hint("merge"), DIGEST), "dedup-held")
    # Both sides are plain scans, so both are shuffled and a hot text can be split by adaptive execution.
    return rows.join(sizes.hint("merge"), DIGEST).select(
        F.col("_id").alias(id_col),
        DIGEST,
        KEEP,
        "group_size",
        F.col("_id").eqNullSafe(F.col(KEEP)).alias("kept"),
    )


def keep_first(docs: DataFrame, index: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``dedup_batch`` keeps, with their columns as they are.

    Repeated rows (same id and text) count as one document: one of them stays.
    """
    verdict = dedup_batch(docs, index, id_col, text_col)
    # Only losers are looked up; none at all in a clean corpus.
    lost = stored(
        verdict.filter(~F.col("kept")).select(F.col(id_col).alias("_lost_id"), F.col(DIGEST).alias("_lost")).distinct(),
        "dedup-lost",
    )
    match = (F.col(id_col).eqNullSafe(F.col("_lost_id"))) & (normalised_digest(text_col) == F.col("_lost"))
    kept = docs.join(sized(lost), match, "left_anti")
    repeated = verdict.filter("kept").groupBy(id_col, DIGEST).count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates([id_col, text_col])
