"""String tables from delimited text or parquet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# File suffix -> format.
FORMATS = {
    "csv": "csv",
    "txt": "tsv",
    "tsv": "tsv",
    "cxsmiles": "tsv",
    "smi": "tsv",
    "parquet": "parquet",
}
COMPRESSION = ("bz2", "gz", "zst", "snappy", "lz4", "deflate")

Paths = str | Sequence[str]


def detect_format(path: str) -> str:
    """Format by suffix, looking past a compression suffix."""
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    if len(parts) > 2 and parts[-1] in COMPRESSION:
        parts.pop()
    fmt = FORMATS.get(parts[-1]) if len(parts) > 1 else None
    if fmt is None:
        raise ValueError(f"unsupported file type: {path}")
    return fmt


def _status(spark: SparkSession, path: str):
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, hpath


def expand_inputs(spark: SparkSession, paths: Paths) -> list[str]:
    """Files named by a path or list of paths; a folder stands for its direct files.

    Every path is checked before anything is read. Works on any file system
    Spark can reach. Hidden files (``_x``, ``.x``) are left out; folders that are
    parquet datasets count as one input.
    """
    return [path for path, _ in _expanded(spark, paths)]


def _expanded(spark: SparkSession, paths: Paths) -> list[tuple[str, int]]:
    """Inputs of ``expand_inputs`` with their bytes, -1 for a folder."""
    if not isinstance(paths, (str, list, tuple)):
        raise ValueError(f"expected a path or a list of paths, got {type(paths).__name__}")
    out: list[tuple[str, int]] = []
    missing = []
    for path in [paths] if isinstance(paths, str) else paths:
        fs, hpath = _status(spark, path)
        if not fs.exists(hpath):
            missing.append(path)
            continue
        status = fs.getFileStatus(hpath)
        if status.isFile() or path.rstrip("/").endswith(".parquet"):
            out.append((path, status.getLen() if status.isFile() else -1))
        else:
            inside = [s for s in fs.listStatus(hpath) if s.isFile() and s.getPath().getName()[0] not in "._"]
            out.extend(sorted((s.getPath().toString(), s.getLen()) for s in inside))
    if missing:
        raise ValueError(f"no such file or folder: {', '.join(missing)}")
    return out


def read_strings(
    spark: SparkSession,
    paths: Paths,
    fmt: str | None = None,
    col: str | int | None = None,
    header: bool | int | None = True,
    out: str = "smiles",
    position: bool = False,
    quote: str = '"',
) -> DataFrame:
    """One string column plus ``_source`` (full file path) from any mix of inputs.

    ``col`` is a column name (csv, parquet; default ``smiles``) or a 0-based
    index (tab-separated; default 0). ``header``: the first line names the columns
    (True or 0) or is data already (False or None). ``position`` adds ``_block`` and ``_pos``, which
    order the rows of a file as written. Only the wanted column is parsed.
    """
    if header is not None and not isinstance(header, bool) and header != 0:
        raise ValueError("only the first line can be the header")
    header = header is not None and header is not False
    files = expand_inputs(spark, paths)
    if not files:
        raise ValueError(f"no input files in {paths}")
    groups: dict[tuple[str, str | None], list[str]] = {}
    for f in files:
        kind = fmt or detect_format(f)
        # a delimited file is read by its own header: files with another order of columns are a group of their own
        first = _first_line(spark, f) if header and kind != "parquet" and len(files) > 1 else None
        groups.setdefault((kind, first), []).append(f)
    frames = [_read_one(spark, kind, group, col, header, out, position, quote) for (kind, _), group in groups.items()]
    return union_tables(frames)


def _first_line(spark: SparkSession, path: str) -> str | None:
    """First line of a plain or compressed text file, read on the driver."""
    fs, hpath = _status(spark, path)
    if not fs.getFileStatus(hpath).isFile():
        return None
    jvm = spark._jvm
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(hpath)
    raw = fs.open(hpath)
    try:
        stream = raw if codec is None else codec.createInputStream(raw)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        raw.close()


def _read_one(spark, kind, files, col, header, out, position, quote) -> DataFrame:
    if kind == "parquet":
        raw = spark.read.parquet(*files)
    elif kind in ("csv", "tsv"):
        reader = spark.read.options(
            sep="," if kind == "csv" else "\t", header=header, quote=quote, escape=quote, inferSchema=False
        )
        raw = reader.csv(files)
    else:
        raise ValueError(f"unsupported format {kind!r}")
    if col is None:
        col = 0 if kind == "tsv" or not header else "smiles"
    if isinstance(col, int):
        if not 0 <= col < len(raw.columns):
            raise ValueError(f"no column {col} among {raw.columns}")
        col = raw.columns[col]
    elif col not in raw.columns:
        raise ValueError(f"no column {col!r} among {raw.columns}")
    quoted = "`" + col.replace("`", "``") + "`"
    wanted = [F.col(quoted).cast("string").alias(out), F.col("_metadata.file_path").alias("_source")]
    if position:
        wanted += [F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_pos")]
    return raw.select(*wanted)


def read_parquet_lenient(
    spark: SparkSession,
    paths: Paths,
    on_error: str = "fail",
    columns: Sequence[str] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Parquet with ``_source``; ``on_error='skip'`` passes over unreadable files.

    ``lost_files`` names them, ``file_ledger`` tells of every file. Without a ``schema``, skipping has to look at every
    footer (a distributed job), as any single one may be the bad one.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error must be 'fail' or 'skip'")
    reader = spark.read
    if on_error == "skip":
        reader = reader.options(ignoreCorruptFiles=True, ignoreMissingFiles=True, mergeSchema=schema is None)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(*expand_inputs(spark, paths))
    return df.select(*(columns or df.columns), F.col("_metadata.file_path").alias("_source"))


EMPTY_FILE_BYTES = 64 << 20  # a Parquet file without rows is a footer, and none is longer


def file_ledger(spark: SparkSession, paths: Paths, schema: str | StructType | None = None) -> DataFrame:
    """One row per Parquet file: ``_source``, ``bytes``, ``modified``, ``status``, ``reason``, ``n_rows`` and ``n_decoded``.

    ``status`` is ``intact``, ``empty`` (intact, no rows), ``damaged`` (rows are lost after ``n_decoded``) or
    ``unreadable``; the last two have a ``reason``. ``n_rows`` is what the footer promises, NULL without one.
    All is done by Spark's readers in three distributed passes: footers alone, all columns of ``schema`` decoded, and the whole
    content of files without a row, if they are short enough to be an empty table. Without a ``schema`` that of the footers
    is merged; at least one must then be readable. A file of no bytes has no ``modified``. Changed bytes that still decode are not seen.
    """
    expanded = _expanded(spark, paths)
    files = [path for path, _ in expanded]
    lenient = spark.read.options(ignoreCorruptFiles=True, ignoreMissingFiles=True, mergeSchema=schema is None)
    rows = (lenient.schema(schema) if schema is not None else lenient).parquet(*files)
    name = _plain(F.col("_metadata.file_path")).alias("_k")
    # no column: only the footers are read
    promised = rows.select(name).groupBy("_k").agg(F.count("*").alias("n_rows"))
    decoded = rows.select(name, F.xxhash64(*map(_quoted, rows.columns)).alias("h")).groupBy("_k")
    decoded = decoded.agg(F.count("*").alias("n_decoded"), F.bit_xor("h").alias("_h")).filter("n_decoded > 0 or _h is null")
    raw = spark.read.format("binaryFile").load(files)
    listed = raw.select(
        F.col("path").alias("_source"), _plain(F.col("path")).alias("_k"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")
    )
    # Spark's readers pass over files of no bytes
    nothing = spark.createDataFrame([(path,) for path, size in expanded if size == 0], "_source string")
    nothing = nothing.select("_source", _plain(F.col("_source")).alias("_k"), F.lit(0).cast("long"), F.lit(None).cast("timestamp"))
    listed = listed.union(nothing)
    magic = F.lit(b"PAR1")
    short = raw.join(promised.select("_k"), _plain(F.col("path")) == F.col("_k"), "left_anti").filter(F.col("length") <= EMPTY_FILE_BYTES)
    ends = short.select(
        _plain(F.col("path")).alias("_k"),
        (F.substring("content", 1, 4) == magic).alias("_head"),
        ((F.substring("content", -4, 4) == magic) & (F.col("length") >= 12)).alias("_tail"),
    )
    found = listed.join(promised, "_k", "left").join(decoded, "_k", "left").join(ends, "_k", "left")
    whole = F.coalesce(F.col("_head") & F.col("_tail"), F.lit(False))
    got = F.coalesce("n_decoded", F.lit(0))
    status = (
        F.when(F.col("n_rows").isNull() & whole, "empty")
        .when(F.col("n_rows").isNull(), "unreadable")
        .when(got < F.col("n_rows"), "damaged")
        .otherwise("intact")
    )
    reason = (
        F.when(F.col("status") == "damaged", F.concat(got, F.lit(" of "), F.col("n_rows"), F.lit(" rows decoded")))
        .when(F.col("status") != "unreadable", F.lit(None))
        .when(F.col("bytes") == 0, "no bytes")
        .when(F.col("_head").isNull(), "footer unreadable")
        .when(~F.col("_head"), "not a parquet file")
        .otherwise("no footer at the end: cut off")
    )
    found = found.withColumn("status", status).withColumn("reason", reason)
    n_rows = F.when(F.col("status") == "empty", 0).otherwise(F.col("n_rows")).cast("long")
    return found.select("_source", "bytes", "modified", "status", "reason", n_rows.alias("n_rows"), got.cast("long").alias("n_decoded"))


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def lost_files(spark: SparkSession, paths: Paths, df: DataFrame) -> DataFrame:
    """Input files of ``df`` (as ``read_parquet_lenient`` gave it) that lost rows, with ``reason``: unreadable or damaged part-way.

    Only the columns of ``df`` are decoded. An intact file without rows is not lost.
    """
    schema = StructType([f for f in df.schema if f.name != "_source"])
    return file_ledger(spark, paths, schema).filter(F.col("status").isin("unreadable", "damaged")).select("_source", "reason")


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several tables with the same columns, matched by name."""
    return reduce(lambda a, b: a.unionByName(b), tables)
