"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is summarised at several resolutions: at resolution s it is cut into s segments, each with its mean and standard
deviation. For a segment of n components the product of two parts is at most n (m m' + d d') with means m and
deviations d, so the sum over segments bounds a score from above (a distance from below). Bounds go from coarse to fine; pairs whose bound
falls below the k-th score known for the query are dropped, and only the survivors are multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecgrid.llm.common import stored

BLOCK_ROWS, QUERY_ROWS = 8192, 512  # vectors in a block of candidates and of queries
SAMPLE = 4096  # candidates that give each query its first k-th score; a fixed bound
LEVELS = (1, 4, 16)
_DENSE = 0.05  # share of a block's pairs above which all of them are bounded (or multiplied) at once
_EXACT = float(1 << 53)


def quantised(col: str, factor: int = 64) -> Column:
    """floor(factor * x) of each component as array<bigint>; NULL if the vector is NULL or holds NULL or a non-finite one."""
    usable = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(col, lambda x: F.floor(x.cast("double") * factor).cast("bigint")))


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of (sqrt(n) mean, sqrt(n) deviation) of each segment: the product of two such rows is the bound."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = np.empty((len(x), 2 * segments))
    for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a == b:
            out[:, 2 * s : 2 * s + 2] = 0
            continue
        part = x[:, a:b]
        root = np.sqrt(b - a)
        out[:, 2 * s] = part.mean(axis=1) * root
        out[:, 2 * s + 1] = part.std(axis=1) * root
    return out


def survivors(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(query row, candidate row, exact score, pairs left after each resolution) of the pairs with a score of at
    least ``least[query]``."""
    scale = 1e-9 * (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1)).max(initial=0.0) + 1)
    floor = least[:, None] - scale  # bounds are computed in floating point
    a = b = None
    left = []
    for segments in LEVELS:
        if 2 * segments > max(2, q.shape[1]):
            break
        sq, sx = segment_statistics(q, segments), segment_statistics(x, segments)
        if a is None or len(a) > _DENSE * len(q) * len(x):
            keep = sq @ sx.T >= floor
            if a is not None:
                alive = np.zeros(keep.shape, bool)
                alive[a, b] = True
                keep &= alive
            a, b = np.nonzero(keep)
        else:
            ok = np.einsum("ij,ij->i", sq[a], sx[b]) >= floor[a, 0]
            a, b = a[ok], b[ok]
        left.append(len(a))
    if len(a) > _DENSE * len(q) * len(x):
        score = _product(q, x.T)[a, b]
    else:
        score = np.concatenate([np.zeros(0), *[_rows_product(q[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)]])
    ok = score >= least[a]
    return a[ok], b[ok], score[ok], left


def _fits(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether products of integers are exact in double precision."""
    return np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < _EXACT


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ x if _fits(q, x.T) else q.astype(np.int64) @ x.astype(np.int64)


def _rows_product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if _fits(q, x):
        return np.einsum("ij,ij->i", q, x)
    return np.einsum("ij,ij->i", q.astype(np.int64), x.astype(np.int64))



def _blocks(vectors: DataFrame, rows: int, label: str) -> DataFrame:
    """Vectors (dim, vec, ids) in blocks of about ``rows``: (dim, block, n_blocks, vecs binary, ids array of arrays).

    The block is a hash of the vector, and vectors are distinct, so blocks are even whatever the data.
    """
    counts = vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("n_blocks"))
    sizes = {r["dim"]: r["n_blocks"] for r in counts.collect()}  # one row per dimension
    if not sizes:
        sizes = {0: 1}
    n_blocks = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in sizes.items()])
    placed = vectors.withColumn("n_blocks", n_blocks).withColumn(
        "block", F.pmod(F.xxhash64("vec", F.lit(11)), F.col("n_blocks")).cast("int")
    )

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        flat = table.column("vec").combine_chunks().flatten().to_numpy().astype(np.int64)
        ids = table.column("ids").combine_chunks()
        return pa.table(
            {
                "dim": pa.array([key[0].as_py()], pa.int32()),
                "block": pa.array([key[1].as_py()], pa.int32()),
                "n_blocks": pa.array([table.column("n_blocks")[0].as_py()], pa.int32()),
                "vecs": pa.array([flat.tobytes()], pa.binary()),
                "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))),
            }
        )

    packed = placed.groupBy("dim", "block").applyInArrow(
        pack, "dim int, block int, n_blocks int, vecs binary, ids array<array<bigint>>"
    )
    return stored(packed, label, "lz4")


def _least_ids(rows: DataFrame, n: int) -> DataFrame:
    """Distinct vectors (dim, vec, ids): the ``n`` smallest distinct ids of each.

    A vector may be that of a third of all rows, so ids are cut down by salt first; Spark cuts them in each task
    before the shuffle.
    """
    salted = Window.partitionBy("vec", "salt").orderBy("id")
    first = (
        rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        .withColumn("r", F.dense_rank().over(salted))
        .filter(F.col("r") <= n)
        .select("vec", "id")
        .distinct()
    )
    cut = first.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("r") <= n)
    return cut.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.size("vec").alias("dim"), "vec", "ids")


def top_k(
    vectors: DataFrame,
    query_filter: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    factor: int = 64,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank from 1, id, score): the ``k`` highest integer inner products of each query with all other
    rows, ties to the smaller id.

    Queries are the rows that ``query_filter`` picks; candidates are all rows with another id. Vectors that are NULL or hold NULL or a
    non-finite component take no part, vectors of different length never meet, empty vectors score 0. Equal
    vectors are searched once, with their k + 1 smallest ids, so large groups of copies cost nothing extra; rows that repeat an id and a vector count once.
    Rows with a NULL id take no part. Without a partner a query has no rows. Other columns are not read.

    A block of queries meets every block of candidates in an equi-join on the block's number. The
    sample of ``sample`` candidates that gives each query its first bound is the only thing sent to all tasks.
    """
    rows = stored(
        vectors.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("bigint").alias("id"), quantised(vec_col, factor).alias("vec"), query_filter.alias("is_query"))
        .filter(F.col("vec").isNotNull()),
        "search-rows",
        "lz4",
    )
    different = stored(_least_ids(rows.select("vec", "id"), k + 1), "search-vectors", "lz4")
    queries = stored(
        rows.filter("is_query").groupBy("vec").agg(F.array(F.min("id")).alias("ids")).select(F.size("vec").alias("dim"), "vec", "ids"),
        "search-queries",
        "lz4",
    )
    candidates = _blocks(different, block_rows, "search-blocks")
    asked = _blocks(queries, query_rows, "search-query-blocks").select(
        "dim", F.col("vecs").alias("q_vecs"), F.transform("ids", lambda x: x.getItem(0)).alias("q_ids")
    )

    drawn = different.orderBy(F.xxhash64("vec", F.lit(5)), "vec").limit(sample)
    drawn = drawn.select("dim", "vec", F.size("ids").alias("n")).toArrow().combine_chunks()
    first: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in set(drawn["dim"].to_pylist()):
        own = drawn.filter(pc.equal(drawn["dim"], dim))
        flat = own["vec"].combine_chunks().flatten().to_numpy()
        first[dim] = (flat.astype(np.int64).reshape(len(own), dim), own["n"].to_numpy())

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A score that k + 1 ids of the sample reach, for each query."""
        for batch in batches:
            least = []
            for dim, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q = np.frombuffer(raw, np.int64)
                n = len(batch.column(2)[len(least)])
                q = q.reshape(n, dim).astype(np.float64)
                x, ids = first.get(dim, (np.zeros((0, dim), np.int64), np.zeros(0, int)))
                if ids.sum() <= k:
                    least.append([-np.inf] * n)
                    continue
                score = _product(q, x.astype(np.float64).T)
                order = np.argsort(-score, axis=1, kind="stable")
                enough = (np.cumsum(ids[order], axis=1) >= k + 1).argmax(axis=1)
                at = order[np.arange(n), enough]
                least.append(score[np.arange(n), at].astype(float).tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(least, pa.list_(pa.float64()))], ["dim", "q_vecs", "q_ids", "least"]
            )

    bounded = asked.mapInArrow(bound, "dim int, q_vecs binary, q_ids array<bigint>, least array<double>")
    blocks_of = {r["dim"]: r["n_blocks"] for r in candidates.select("dim", "n_blocks").distinct().collect()} or {0: 1}
    count = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in blocks_of.items()], F.lit(0))
    spread = bounded.filter(count > 0).select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    # Packed blocks and vectors compress well, so planners take large tables for small ones and would send them through the driver.
    pairs = spread.join(candidates.select("dim", "block", "vecs", "ids").hint("merge"), ["dim", "block"]).select(
        "dim", "q_vecs", "q_ids", "least", "vecs", "ids"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, q_raw, q_ids, least, raw, ids = (batch.column(c)[i].as_py() for c in range(6))
                q = np.frombuffer(q_raw, np.int64).reshape(len(q_ids), dim).astype(np.float64)
                x = np.frombuffer(raw, np.int64).reshape(len(ids), dim).astype(np.float64)
                a, b, score, _ = survivors(q, x, np.array(least))
                out = _best(a, b, score, ids, k + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(q_ids, np.int64)[out[0]]), pa.array(out[1]), pa.array(out[2])], ["q", "id", "score"]
                )

    found = pairs.mapInArrow(search, "q bigint, id bigint, score bigint")
    by_query = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = found.withColumn("r", F.row_number().over(by_query)).filter(F.col("r") <= k + 1).drop("r")
    best = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best"))
    named = queries.select(F.col("ids").getItem(0).alias("q"), "vec")
    best = stored(best.join(named.hint("merge"), "q").select("vec", "best"), "search-best", "lz4")
    # every query row gets the list of its vector, without itself
    asking = rows.filter("is_query").select(F.col("id").alias("query_id"), "vec").distinct()
    own = asking.join(best.hint("merge"), "vec").select(
        "query_id", F.slice(F.filter("best", lambda x: x.getField("id") != F.col("query_id")), 1, k).alias("best")
    )
    return own.select("query_id", F.posexplode("best").alias("p", "x")).select(
        "query_id",
        (F.col("p") + 1).cast("int").alias("rank"),
        F.col("x.id").alias(id_col),
        (-F.col("x.s")).alias("score"),
    )


def _best(a: np.ndarray, b: np.ndarray, score: np.ndarray, ids: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the ``k`` best ids of each query among the surviving pairs."""
    many = np.array([len(x) for x in ids])
    flat = np.array([v for x in ids for v in x], np.int64)
    times = many[b]
    row, value = np.repeat(a, times), np.repeat(score, times).astype(np.int64)
    begins = np.repeat((np.cumsum(many) - many)[b] - (np.cumsum(times) - times), times)
    found = flat[begins + np.arange(len(row))] if len(row) else flat[:0]
    order = np.lexsort((found, -value, row))
    row, found, value = row[order], found[order], value[order]
    new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) if len(row) else np.zeros(0, int)
    keep = np.arange(len(row)) - start < k
    return row[keep], found[keep], value[keep]
