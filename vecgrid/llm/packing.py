"""Concatenate-and-cut packing of tokenised documents into fixed windows.

First pass: every task tokenises its documents, numbers their tokens from 0 within the task and
writes the ids once. A prefix sum over the tasks' totals (one row per task) turns these
into global offsets. Second pass: the token stream is cut every ``window`` ids; a document that
crosses a cut becomes several pieces, its boundary records.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecgrid.llm.common import MEMO_BYTES, SpaceCutEncoder, bounded_batches, spans, stored, text_of

WINDOW, END_ID = 1024, 0
_PIECES = 1024  # rows in an output batch


class RankEncoder(SpaceCutEncoder):
    """Texts to ids by a byte-level BPE vocabulary in a file of ranks, as the ``tokenizers`` library has it.

    A text is cut where the tokeniser's own pattern always cuts, before single spaces, by Arrow kernels that also number
    the different words; a word is encoded once for as long as the bounded memo (``memo`` bytes) holds
    it, and the new words of a batch in one call. Strings in ``added`` become their one id, as added tokens of the library
    do, and the parts between them are encoded by themselves; without ``added`` they are ordinary text.
    """

    def __init__(self, ranks: str, pattern: str, memo: int = MEMO_BYTES, added: dict[str, int] | None = None):
        import tiktoken

        super().__init__(memo)
        self.added = added or {}
        self.cut = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.token_bytes = np.zeros(max(merges.values()) + 1, np.int64)
        for token, rank in merges.items():
            self.token_bytes[rank] = len(token)

    def _encode(self, fresh: list[str]) -> list[bytes]:
        """Ids of words that follow a space. In a row they are still cut before each space, so one call does for all."""
        ids = np.array(self.encoding.encode_ordinary("".join([" " + w for w in fresh])), "<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in fresh])
        cuts = (4 * (np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1)).tolist()
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _alone(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in re.split(f"({self.cut})", text) if self.added else [text]:
            ids += [self.added[piece]] if piece in self.added else self.encoding.encode_ordinary(piece)
        return np.array(ids, "<u4").tobytes()


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens of a ``tokenizers`` file; these are found in the raw text before anything else."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError("added tokens that take in white space or stand for whole words only")
    return {t["content"]: t["id"] for t in tokens}


def tokenise(
    docs: DataFrame,
    make_encoder: Callable[[], Callable[[pa.Array], Iterable[bytes]]],
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
) -> DataFrame:
    """First pass, written: (_id, part, start, doc_tokens, ids) for each row; ``start`` counts the ids of
    the rows before it in the same task, ``ids`` ends with ``end_id``."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    schema = T.StructType(
        [
            source.schema["_id"],
            T.StructField("part", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, total = make_encoder(), TaskContext.get().partitionId(), 0
        for batch in (b.slice(k, n) for b in batches for k, n in spans(b.column(1))):
            ids = [x + end for x in encode(batch.column(1))]
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            starts = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            columns = [batch.column(0), np.full(len(ids), part), starts, sizes, pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema.names)

    return stored(source.mapInArrow(run, schema), "token-ids")


def pack(
    docs: DataFrame,
    make_encoder: Callable[[], Callable[[pa.Array], Iterable[bytes]]],
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    ``start`` counts the document's ids before the piece, ``offset`` the ids before it in its
    sequence, ``ids`` is the piece as array<int>. All sequences hold ``window`` ids but the last one, the
    only one that needs padding. NULL and empty texts are one piece with the end id alone. NULL and
    repeated ids are documents like any other. No rows give no pieces. Other columns are not read.
    """
    spark = docs.sparkSession
    tokens = tokenise(docs, make_encoder, id_col, text_col, end_id)
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()  # a row per task
    before = np.cumsum([0, *[r["n"] for r in totals]])
    bases = spark.createDataFrame(
        [(int(r["part"]), int(b)) for r, b in zip(totals, before, strict=False)], "part long, base long"
    )
    located = tokens.join(F.broadcast(bases), "part").select(
        "_id", (F.col("base") + F.col("start")).alias("at"), "doc_tokens", "ids"
    )
    fields = [T.StructField(id_col, tokens.schema["_id"].dataType)] + [
        T.StructField(n, T.LongType())
        for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, sizes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            # pieces of a row: one for each window that its ids touch
            counts = (ats + sizes - 1) // window - ats // window + 1
            row = np.repeat(np.arange(len(ats)), counts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            sequence = ats[row] // window + nth
            lo = np.maximum(ats[row], sequence * window)
            hi = np.minimum(ats[row] + sizes[row], (sequence + 1) * window)
            start, length = lo - ats[row], hi - lo
            for a in range(0, len(row), _PIECES):
                cut = slice(a, a + _PIECES)
                views = [
                    memoryview(batch.column(3)[int(r)].as_buffer())[4 * s : 4 * (s + n)]
                    for r, s, n in zip(row[cut], start[cut], length[cut], strict=True)
                ]
                arrays = [
                    batch.column(0).take(pa.array(row[cut])),
                    pa.array(start[cut]),
                    pa.array(length[cut]),
                    pa.array([zlib.crc32(v) for v in views], pa.int64()),
                    pa.array(sizes[row[cut]]),
                    pa.array(sequence[cut]),
                    pa.array((lo - sequence * window)[cut]),
                ]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(views), "<i4"))
                    ends = np.concatenate([[0], np.cumsum(length[cut])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return located.mapInArrow(run, schema)
