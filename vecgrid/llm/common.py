"""What the operators of this subpackage share: scratch tables, text maps, hash folds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrid.session import scratch_path

SPACE = r"[\x20\x09-\x0D]+"  # the white space of the contracts, as a regular expression


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, codec: str = "zstd", file_rows: int = 0) -> DataFrame:
    """``df`` written once as Parquet in the shared scratch folder and read back.

    Cuts lineage like a reliable checkpoint, but compressed, columnar, with exact
    sizes for the planner. Random or order-dependent values stay fixed from here on. ``file_rows`` (0: any number) bounds the rows
    of a file: Parquet holds 100 rows before it looks at their size, and is read in batches of 4,096, however large rows are.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 500_000  # of a narrow table that is sent to every task; larger ones meet in a sort-merge join


def sized(narrow: DataFrame) -> DataFrame:
    """A written table of ids or digests with the join that its counted rows allow: broadcast if they are few, merge otherwise."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow.hint("merge")


def text_of(col: str) -> Column:
    """A text column with NULL as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id written as text, modulo ``k``; a NULL id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % k, F.lit(0))


def per_text(make: Callable[[], Callable[[pa.Array], list[pa.Array]]], schema: str) -> Callable[[Column], Column]:
    """A struct-valued column function of one text column, evaluated in Arrow batches.

    ``make`` runs once in each task and returns the batch function: an array of texts
    in, one Arrow array for each field out. Only the argument goes through Python.
    Marked as not deterministic so that the planner never evaluates it twice.
    """
    bounded_batches()
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        batch = make()
        for texts in batches:
            yield pa.StructArray.from_arrays(batch(texts), names=names)

    return F.arrow_udf(run, schema).asNondeterministic()


BATCH_BYTES = 8 << 20  # of a batch that Spark sends to Python, or a single row
SLICE_BYTES = 3 << 20  # of text that is cut into words at once


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Have Spark cut batches for Python by bytes, so that rows of any length take the same memory."""
    (spark or SparkSession.active()).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spans(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive runs of an array of texts, each of about ``size`` bytes or a single text."""
    ends = np.cumsum(pc.binary_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, stop - at
        at = stop


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of an array of texts, NULL as empty, each of about ``SLICE_BYTES`` or a single text."""
    texts = pc.fill_null(texts, "")
    for first, n in spans(texts):
        yield texts.slice(first, n)


def words(texts: pa.Array, by: str | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Cut texts at ``by`` (None: at white space) and number the different words.

    Returns (different words, the number of each word of all texts in order, where each text begins in these and the
    end). The cutting and numbering are Arrow kernels; Python sees a word once for each slice.
    """
    lists = pc.utf8_split_whitespace(texts) if by is None else pc.split_pattern(texts, by)
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), offsets - offsets[0]


def ragged_take(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + size]``, one after the other."""
    ends = np.cumsum(sizes)
    if not len(sizes) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


MEMO_BYTES = 24 << 20  # of words and their values that a memo holds, both generations together
_ENTRY = 110  # bytes that an entry takes beside its word and value


class Memo:
    """Values by word, in two generations: when the new one holds half of ``limit`` bytes it becomes the old one, which stays
    until the next change unless its words are used again. ``fn`` computes the values of a list of new words."""

    def __init__(self, fn: Callable[[list[str]], list], limit: int = MEMO_BYTES):
        self.fn, self.limit = fn, limit
        self.new, self.old, self.size = {}, {}, 0

    def of(self, different: list[str]) -> list:
        """Values of different words; the new ones are computed together."""
        if self.size >= self.limit // 2:
            self.old, self.new, self.size = self.new, {}, 0
        new, old = self.new, self.old
        fresh = [w for w in different if w not in new]
        if fresh:
            unknown = [w for w in fresh if w not in old]
            found = dict(zip(unknown, self.fn(unknown), strict=True))
            found.update((w, old[w]) for w in fresh if w in old)
            self.size += sum(map(getsizeof, found)) + sum(map(getsizeof, found.values())) + _ENTRY * len(found)
            new.update(found)
        return list(map(new.__getitem__, different))


#: White space of the tokeniser's pattern (the Unicode property, unlike Python's own class).
_BLANK = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


class SpaceCutEncoder:
    """Texts to packed ids for tokenisers whose pattern always cuts before a single space that a word follows.

    Arrow kernels cut there and number the different words; a word is encoded once for as long as the bounded memo (``memo``
    bytes) holds it. A class that builds on this one gives ``_encode``, the ids of words that follow a space, and ``_alone``,
    those of a text as it is. Strings in ``added`` stand for themselves, so texts with one are encoded alone.
    """

    def __init__(self, memo: int = MEMO_BYTES):
        self.added: dict[str, int] = {}
        self.known = Memo(self._encode, memo)

    def _encode(self, fresh: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _alone(self, text: str) -> bytes:
        raise NotImplementedError

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; NULL is the empty text."""
        for part in slices(texts):
            different, number, at = words(part, " ")
            # runs of spaces, spaces at an end, white space after a space, added tokens: such texts are encoded by themselves
            rare = np.array([not w or w[0] in _BLANK for w in different])
            slow = np.logical_or.reduceat(rare[number], at[:-1])
            for token in self.added:
                slow |= pc.match_substring(part, token).to_numpy(zero_copy_only=False)
            ids = self.known.of(["-" if r else w for w, r in zip(different, rare.tolist(), strict=True)] if rare.any() else different)
            # the first word of a text has no space before it, and a slow text is one entry as a whole
            heads = number[at[:-1]].tolist()
            ids += [
                self._alone(part[k].as_py() if s else different[h]) for k, (s, h) in enumerate(zip(slow.tolist(), heads, strict=True))
            ]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            entry = number.copy()
            entry[at[:-1]] = len(different) + np.arange(len(part))
            taken = sizes[entry]
            rest = np.repeat(slow, np.diff(at))
            rest[at[:-1]] = False
            taken[rest] = 0
            flat = ragged_take(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(sizes) - sizes)[entry], taken)
            bounds = np.concatenate([[0], np.cumsum(taken)])[at].tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield flat[a:b].tobytes()
