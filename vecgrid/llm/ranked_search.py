"""Ranked lexical search by Block-Max MaxScore over shards of documents.

Each task cuts its documents into shards and writes one inverted index for each: postings in blocks of ``BLOCK`` documents, packed
in as few bytes as a block needs, with the (frequency, length) pairs of a block that no other pair of it beats. These pairs do not
depend on statistics of the whole corpus, so an index is written in one pass, and they give the exact maximum of a block later.

A query scores a shard by its lists in order of their largest scores. While the sum of the smallest ones stays below the score
that a document must reach, these lists are not essential: no document is taken from them. Documents of the essential lists
are rejected by the maxima of the blocks they would be in, before such a block is unpacked. The best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecgrid.llm.common import bounded_batches, ragged_take, slices, spans, stored, text_of, words

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what lies between terms
BLOCK = 128
SHARD_BYTES, SHARD_DOCS = 12 << 20, 60_000  # of the texts of a shard, or one text
QUERY_ROWS, QUERY_BYTES = 4096, 4 << 20  # of queries that are asked at once
SCALE, FREE, SHARE = 1_000_000_000, 10, 90  # fixed values of the score


# ---------------------------------------------------------------- terms


def cut_terms(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different terms of texts, the number of each term in order, where each text begins in these; A-Z is lower-cased.

    A text without terms has one term that is the empty string.
    """
    return words(pc.utf8_trim(pc.replace_substring_regex(pc.ascii_lower(texts), BETWEEN, " "), " "), " ")


def query_terms(texts: Sequence[str | None]) -> list[list[str]]:
    """The different terms of each text, sorted."""
    out: list[list[str]] = []
    for part in slices(pa.array(texts, pa.string())):
        different, number, at = cut_terms(part)
        out += [sorted({different[k] for k in number[a:b].tolist()} - {""}) for a, b in zip(at, at[1:], strict=False)]
    return out


# ---------------------------------------------------------------- index


INDEX = (
    "n_docs long, n_terms long, ids array<{}>, lengths binary, terms array<string>, df array<int>, "
    "head binary, impact binary, packed binary"
)


@dataclass
class Lists:
    """Postings of a shard as they are stored: ``head`` has for each block (first document, documents, bytes at, widths, impacts
    at), ``first_block`` the number of each term's first block, ``impact`` the pairs (frequency, length)."""

    first_block: np.ndarray
    head: np.ndarray
    impact: np.ndarray
    packed: bytes


def _widths(most: np.ndarray) -> np.ndarray:
    """Bytes that numbers up to ``most`` need: 0, 1, 2 or 4."""
    return np.select([most == 0, most < 1 << 8, most < 1 << 16], [0, 1, 2], 4)


def _pack(values: np.ndarray, width: np.ndarray, size: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Write the numbers of each block with its width to ``out`` from byte ``at`` on."""
    for w in (1, 2, 4):
        mine = np.flatnonzero(width == w)
        if len(mine):
            flat = ragged_take(values, (np.cumsum(size) - size)[mine], size[mine]).astype(f"<u{w}").view(np.uint8)
            target = ragged_take(np.arange(len(out)), at[mine], size[mine] * w)
            out[target] = flat


def build(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray, n_terms: int) -> Lists:
    """Blocks of postings that are sorted by term and document."""
    counts = np.bincount(term, minlength=n_terms)
    blocks = -(-counts // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    of_term = np.repeat(np.arange(n_terms), blocks)
    nth = np.arange(len(of_term)) - first_block[of_term]
    starts = (np.cumsum(counts) - counts)[of_term] + nth * BLOCK
    size = np.minimum(BLOCK, counts[of_term] - nth * BLOCK)
    block = np.repeat(np.arange(len(size)), size)
    step = doc - doc[starts][block]
    doc_width = _widths(step[starts + size - 1])
    tf_width = _widths(np.maximum.reduceat(tf - 1, starts)) if len(starts) else size
    bytes_of = size * (doc_width + tf_width)
    at = np.cumsum(bytes_of) - bytes_of
    out = np.zeros(int(bytes_of.sum()), np.uint8)
    _pack(step, doc_width, size, at, out)
    _pack(tf - 1, tf_width, size, at + size * doc_width, out)
    # The pairs of a block that no other one beats: by falling frequency, those with a length below all before.
    length = lengths[doc]
    order = np.lexsort((length, -tf, block))
    far = np.int64(1) << 40
    low = np.minimum.accumulate(length[order] - block[order] * far)
    keep = np.ones(len(order), bool)
    keep[1:] = low[1:] < low[:-1]
    order = order[keep]
    impact = np.stack([tf[order], length[order]], axis=1).astype("<i8")
    impacts_at = np.searchsorted(block[order], np.arange(len(size)))
    head = np.stack([doc[starts], size, at, doc_width, tf_width, impacts_at], axis=1).astype("<i8")
    return Lists(first_block, head, impact, out.tobytes())


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all whole texts, written: one row, and one file, for each shard. Nothing is shuffled.

    NULL, empty and blank texts have no terms and are in no shard. NULL and repeated ids are documents like any other.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    kind = source.schema["_id"].dataType
    schema = T._parse_datatype_string(INDEX.format(kind.simpleString()))
    names = schema.names

    def shard(held: list[tuple[pa.Array, pa.Array]]) -> pa.RecordBatch | None:
        chunks, ids, per_doc = [], [], []
        for some, texts in held:
            different, number, at = cut_terms(texts)
            chunks.append(pa.DictionaryArray.from_arrays(pa.array(number, pa.int32()), pa.array(different, pa.string())))
            ids.append(some)
            per_doc.append(np.diff(at))
        # One numbering of the terms of all parts, in the order of the terms.
        joined = pa.chunked_array(chunks).unify_dictionaries()
        terms = joined.chunk(0).dictionary
        by_name = pc.array_sort_indices(terms).to_numpy()
        place = np.empty(len(by_name), np.int64)
        place[by_name] = np.arange(len(by_name))
        number = place[np.concatenate([c.indices.to_numpy() for c in joined.chunks])]
        terms = terms.take(pa.array(by_name))
        per_doc = np.concatenate(per_doc)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        if len(terms) and not terms[0].as_py():  # the empty term of texts without terms
            real = number > 0
            doc, number, terms = doc[real], number[real] - 1, terms.slice(1)
        if not len(number):
            return None
        lengths = np.bincount(doc, minlength=len(per_doc))
        pairs, tf = np.unique(number << 32 | doc, return_counts=True)
        made = build(pairs >> 32, pairs & 0xFFFFFFFF, tf, lengths, len(terms))
        df = np.bincount(pairs >> 32, minlength=len(terms))
        one = lambda array: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
        columns = [
            pa.array([int((lengths > 0).sum())]),
            pa.array([len(number)]),
            one(pa.concat_arrays(ids)),
            pa.array([lengths.astype("<i8").tobytes()]),
            one(terms),
            one(pa.array(df, pa.int32())),
            pa.array([made.head.tobytes()]),
            pa.array([made.impact.tobytes()]),
            pa.array([made.packed]),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0
        for batch in batches:
            for first, n in spans(batch.column(1)):
                ids, texts = batch.column(0).slice(first, n), batch.column(1).slice(first, n)
                if held and (size + texts.nbytes > SHARD_BYTES or rows + n > SHARD_DOCS):
                    yield from filter(None, [shard(held)])
                    held, size, rows = [], 0, 0
                held.append((ids, texts))
                size, rows = size + texts.nbytes, rows + n
        if held:
            yield from filter(None, [shard(held)])

    return stored(source.mapInArrow(run, schema), "search-index", file_rows=1)


# ---------------------------------------------------------------- scores


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """8 m for documents of so many terms."""
    return 8 * (FREE + SHARE * lengths.astype(np.int64) * n_docs // n_terms)


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + norm)


class Shard:
    """One shard with the statistics of the corpus: unpacks blocks as they are asked for and keeps the maxima of blocks."""

    def __init__(self, row: dict[str, pa.Scalar], wanted: set[str], n_docs: int, n_terms: int):
        self.ids = row["ids"].values
        lengths = np.frombuffer(row["lengths"].as_buffer(), "<i8")
        self.norm = norms(lengths, n_docs, n_terms)
        self.n = len(lengths)
        self.head = np.frombuffer(row["head"].as_buffer(), "<i8").reshape(-1, 6)
        self.packed = row["packed"].as_buffer()
        impact = np.frombuffer(row["impact"].as_buffer(), "<i8").reshape(-1, 2)
        best = impacts(impact[:, 0], norms(impact[:, 1], n_docs, n_terms))
        self.block_max = np.maximum.reduceat(best, self.head[:, 5])
        df = row["df"].values.to_numpy()
        first = np.concatenate([[0], np.cumsum(-(-df // BLOCK))])
        terms = row["terms"].values
        at = pc.indices_nonzero(pc.is_in(terms, pa.array(sorted(wanted), pa.string()))).to_numpy()
        self.blocks = {t: (int(first[k]), int(first[k + 1])) for t, k in zip(terms.take(pa.array(at)).to_pylist(), at.tolist(), strict=True)}
        self.list_max = {t: int(self.block_max[a:b].max()) for t, (a, b) in self.blocks.items()}
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.n_unpacked = 0

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block."""
        got = self.unpacked.get(k)
        if got is None:
            first, size, at, doc_width, tf_width, _ = self.head[k].tolist()
            doc = np.full(size, first)
            if doc_width:
                doc = doc + np.frombuffer(self.packed, f"<u{doc_width}", size, at)
            tf = np.ones(size, np.int64)
            if tf_width:
                tf = tf + np.frombuffer(self.packed, f"<u{tf_width}", size, at + size * doc_width)
            got = self.unpacked[k] = (doc, impacts(tf, self.norm[doc]))
            self.n_unpacked += 1
        return got

    def postings(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        got = self.whole.get(term)
        if got is None:
            docs, values = zip(*map(self.block, range(*self.blocks[term])), strict=True)
            got = self.whole[term] = (np.concatenate(docs), np.concatenate(values))
        return got

    def search(self, terms: Sequence[tuple[str, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the best ``k`` with ``least`` or more, at least all that are.

        ``terms`` are (term, weight). A list is added to the essential ones, largest first, until the rest together can't reach
        ``least``; that bound rises to the k-th best partial score as lists are added up.
        """
        lists = sorted(((w * self.list_max[t], t, w) for t, w in terms if t in self.blocks and w > 0), reverse=True)
        rest = np.concatenate([np.cumsum([x[0] for x in lists][::-1])[::-1], [0]]).tolist()  # of this list and all after it
        score = np.zeros(self.n, np.int64)
        met = 0
        for bound, term, weight in lists:
            if rest[met] < least:
                break
            doc, value = self.postings(term)
            score[doc] += weight * value
            met += 1
            if met < len(lists) and self.n > k:
                least = max(least, int(np.partition(score, self.n - k)[self.n - k]))
        alive = np.flatnonzero((score > 0) & (score + rest[met] >= least))
        for n, (bound, term, weight) in enumerate(lists[met:], met):
            if not len(alive):
                break
            lo, hi = self.blocks[term]
            at = np.searchsorted(self.head[lo:hi, 0], alive, "right") - 1  # the block that a document would be in
            own = np.where(at >= 0, weight * self.block_max[lo + np.maximum(at, 0)], 0)
            going = score[alive] + own + rest[n + 1] >= least
            alive, at = alive[going], at[going]
            for b in np.unique(at[at >= 0]).tolist():
                doc, value = self.block(lo + b)
                mine = alive[at == b]
                place = np.minimum(np.searchsorted(doc, mine), len(doc) - 1)
                found = doc[place] == mine
                score[mine[found]] += weight * value[place[found]]
            alive = alive[score[alive] + rest[n + 1] >= least]
            if len(alive) > k:
                least = max(least, int(np.partition(score[alive], len(alive) - k)[len(alive) - k]))
        alive = alive[score[alive] >= least]
        return alive, score[alive]


# ---------------------------------------------------------------- search


def weights(index: DataFrame, terms: Iterable[str], n_docs: int) -> dict[str, int]:
    """Weight of each of the terms that the index holds; ``terms`` are those of one block of queries."""
    spark = index.sparkSession
    asked = spark.createDataFrame(pa.table({"t": pa.array(sorted(terms), pa.string())}))
    entries = index.select(F.explode(F.arrays_zip("terms", "df")).alias("e")).select(F.col("e.terms").alias("t"), F.col("e.df").alias("df"))
    df = entries.join(F.broadcast(asked), "t").groupBy("t").agg(F.sum("df").alias("df"))
    rows = df.select("t", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).alias("w"))
    return {r["t"]: int(r["w"]) for r in rows.collect()}


def query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Blocks of at most ``QUERY_ROWS`` rows or ``QUERY_BYTES`` of text, (id, text); only one is held at a time."""
    held, size = [], 0
    for row in queries.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        held.append((row["i"], row["t"]))
        size += len(row["t"] or "")
        if len(held) == QUERY_ROWS or size > QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def top_k(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    index: DataFrame | None = None,
) -> DataFrame:
    """(query id, rank, document id, score): the ``k`` documents of each query with the highest scores above 0.

    Equal scores go by document id, NULL last. Queries are asked in blocks, each against all shards; a row of ``queries`` is a query of
    its own, also with a repeated or NULL id. A query without known terms, or NULL, has no rows. ``index`` may be one that
    ``index_documents`` has written before. Other columns are not read.
    """
    spark = docs.sparkSession
    index = index_documents(docs, id_col, text_col) if index is None else index
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_docs, n_terms = int(totals[0]), int(totals[1])
    kind = docs.schema[id_col].dataType
    parts = []
    for block in query_blocks(queries, query_id, query_text):
        asked = query_terms([t for _, t in block])
        weight = weights(index, set().union(*asked), n_docs)
        asked = [[(t, weight[t]) for t in terms if t in weight] for terms in asked]
        found = _search(index, asked, set(weight), k, n_docs, n_terms, kind)
        best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("d").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("i", queries.schema[query_id].dataType)]))
        parts.append(ranked.join(F.broadcast(names), "q").select(F.col("i").alias(query_id), "rank", F.col("d").alias(id_col), "score"))
    if not parts:
        return queries.limit(0).select(F.col(query_id), F.lit(0).alias("rank"), F.lit(None).cast(kind).alias(id_col), F.lit(0).cast("long").alias("score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _search(index: DataFrame, asked: list[list[tuple[str, int]]], wanted: set[str], k: int, n_docs: int, n_terms: int, kind: T.DataType) -> DataFrame:
    """(q, d, score): the best of the shards of each task, a superset of the best of all."""
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("d", kind), T.StructField("score", T.LongType())])
    bounded_batches(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple]] = [[] for _ in asked]  # (-score, id is NULL, id)
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard({n: batch.column(n)[r] for n in batch.schema.names}, wanted, n_docs, n_terms)
                for q, terms in enumerate(asked):
                    heap = heaps[q]
                    least = -heap[-1][0] if len(heap) == k else 1
                    docs, scores = shard.search(terms, k, least)
                    if len(docs):
                        ids = shard.ids.take(pa.array(docs)).to_pylist()
                        heap += [(-s, i is None, i) for s, i in zip(scores.tolist(), ids, strict=True)]
                        heap.sort(key=_order)
                        del heap[k:]
        rows = [(q, i, -s) for q, heap in enumerate(heaps) for s, _, i in heap]
        q, d, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa_kind), pa.array(s, pa.int64())], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(kind)
    return index.select("ids", "lengths", "terms", "df", "head", "impact", "packed").mapInArrow(run, schema)


def _order(entry: tuple) -> tuple:
    return entry if entry[2] is not None else (*entry[:2], 0)
