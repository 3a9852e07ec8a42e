"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols. For each different reduced word all reduced words within one edit are generated, as 64-bit
hashes, and joined with the reduced vocabulary; the words behind a pair that meets are compared as they are. Words one edit apart
have reduced words at most one edit apart, so no pair is lost, and reducing first keeps the neighbourhoods small.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrid.llm.common import bounded_batches, per_text, slices, stored, text_of, words

RUN = r"[^A-Za-z\x{C0}-\x{FF}]+"  # what lies between runs of letters
SYMBOLS = 8
MIN_LETTERS, MIN_COUNT, RATIO, MODULUS = 5, 3, 2, 97
ROUNDS = 64
_HELD = 200_000  # different words that a task adds up before it sends them on
_GENERATED = 1 << 18  # hashes generated at once
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- vocabulary


def damaged(run: str, h: int) -> str:
    """The run without the letter that ``h`` names."""
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(prefixes: list[int], texts: pa.Array, modulus: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """(words, counts) of parts of ``texts``; ``prefixes``: the checksum that the checksums of a text's runs go on from."""
    first = 0
    for part in slices(texts):
        cut = pc.utf8_trim(pc.replace_substring_regex(pc.ascii_lower(part), RUN, " "), " ")
        runs, number, at = words(cut, " ")
        doc = np.repeat(np.arange(len(part)), np.diff(at))
        pairs, n = np.unique(doc << 32 | number, return_counts=True)
        which, owner = pairs & 0xFFFFFFFF, pairs >> 32
        coded = [r.encode() for r in runs]
        start = prefixes[first : first + len(part)]
        h = np.fromiter(
            map(zlib.crc32, map(coded.__getitem__, which.tolist()), map(start.__getitem__, owner.tolist())), np.int64, len(pairs)
        )
        hit = h % modulus == 0
        whole = np.bincount(which[~hit], n[~hit], len(runs)).astype(np.int64)
        odd = [damaged(runs[w], x) if runs[w] else "" for w, x in zip(which[hit].tolist(), h[hit].tolist(), strict=True)]
        yield runs + odd, np.concatenate([whole, n[hit]])
        first += len(part)


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
    modulus: int = MODULUS,
) -> DataFrame:
    """(word, n): runs of letters of all whole texts with at least ``min_letters`` letters and ``min_count`` occurrences.

    A-Z is lower-cased. Where the CRC-32 of ``<id>:<run>`` is divisible by ``modulus``, the run lacks one letter, as the
    contract has it; a NULL id is written as nothing. Tasks add up their own counts, so a frequent word is one row a task.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            sums = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return sums.select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            start = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()]
            for some, n in _counted(start, batch.column(1), modulus):
                table = pa.table({"word": pa.array(some, pa.string()), "n": n})
                table = table.filter(pc.and_(pc.greater_equal(pc.utf8_length(table["word"]), min_letters), pc.greater(table["n"], 0)))
                held.append(table)
                size += len(table)
                if size > _HELD:
                    held = [merged()]
                    size = len(held[0])
                    if size > _HELD // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from merged().to_batches()

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), text_of(text_col).alias("_text"))
    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---------------------------------------------------------------- neighbours


def symbols(points: np.ndarray, k: int = SYMBOLS) -> np.ndarray:
    """Symbols 1 to k of code points."""
    return (points.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(k) + np.uint64(1)


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _MIX
    return (h ^ h >> np.uint64(29)).view(np.int64)


def _powers(n: int) -> np.ndarray:
    """1, B, B^2, ... of the hash's base."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)


def _polynomial(s: np.ndarray) -> np.ndarray:
    """Hash of each row of symbols before it is finished: sum of s[i] B^(last - i)."""
    return (s * _powers(s.shape[1] - 1)[::-1]).sum(axis=1, dtype=np.uint64)


def reduced_words(texts: list[str], k: int = SYMBOLS) -> list[str]:
    """Each word with its letters hashed to symbols."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    joined = (symbols(points, k).astype(np.uint32) + np.uint32(64)).tobytes().decode("utf-32-le")
    ends = np.cumsum([0, *map(len, texts)]).tolist()
    return [joined[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def reduced_hash(texts: list[str], k: int = SYMBOLS) -> np.ndarray:
    """Hash of each reduced word, as signed 64-bit integers."""
    out = np.zeros(len(texts), np.int64)
    for n, at in _by_length(texts).items():
        out[at] = _finished(_polynomial(_matrix([texts[i] for i in at], n, k)))
    return out


def _by_length(texts: list[str]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        found.setdefault(len(t), []).append(i)
    return found


def _matrix(texts: list[str], n: int, k: int) -> np.ndarray:
    return symbols(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), k).reshape(len(texts), n)


def neighbourhood(texts: list[str], k: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(own hash, hash) of the reduced words one deletion or one replacement by a later symbol away, in parts.

    An insertion is a deletion seen from the other word, a replacement by an earlier symbol a later one's: each two
    neighbours meet from one side, and the neighbourhoods together are the full ones.
    """
    for n, at in _by_length(texts).items():
        step = max(1, _GENERATED // (n * k))
        for lo in range(0, len(at), step):
            s = _matrix([texts[i] for i in at[lo : lo + step]], n, k)
            power = _powers(n)
            whole, own = _polynomial(s), None
            own = _finished(whole)
            weighted = s * power[:n][::-1]
            suffix = np.cumsum(weighted[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]  # from place i on
            # the letters before the gap move down by one place: (whole - suffix) / B, by the running hash of prefixes
            prefix = np.zeros((len(s), n), np.uint64)
            for i in range(1, n):
                prefix[:, i] = prefix[:, i - 1] * _BASE + s[:, i - 1]
            rest = np.concatenate([suffix[:, 1:], np.zeros((len(s), 1), np.uint64)], axis=1)
            gone = _finished(prefix * power[:n][::-1] + rest)
            fresh = np.ones_like(gone, bool)
            fresh[:, 1:] = s[:, 1:] != s[:, :-1]  # of a run of equal symbols any is the same deletion
            yield np.repeat(own, n)[fresh.ravel()], gone[fresh]
            for more in range(1, k):
                later = s + np.uint64(more) <= k
                changed = _finished(whole[:, None] + np.uint64(more) * power[:n][::-1])
                yield np.repeat(own, n)[later.ravel()], changed[later]


def near_words(vocab: DataFrame, k: int = SYMBOLS) -> DataFrame:
    """(a, b, n_a, n_b): all pairs of different words of ``vocab`` (word, n) one edit apart, each once.

    The generated hashes and the reduced vocabulary meet in a shuffle join on the hash. Words with the same reduced word are
    a pair of it with itself. Hashes that agree by chance cost a comparison.
    """
    spark = vocab.sparkSession
    bounded_batches(spark)

    def hashed(texts: pa.Array) -> list[pa.Array]:
        some = texts.to_pylist()
        return [pa.array(reduced_words(some, k), pa.string()), pa.array(reduced_hash(some, k))]

    with_hash = vocab.select("word", "n", per_text(lambda: hashed, "r string, h long")(F.col("word")).alias("_r"))
    placed = stored(with_hash.select("word", "n", "_r.r", "_r.h"), "spelling-words")
    # Reduced words whose hashes agree by chance stay apart, so that all neighbourhoods are generated.
    reduced = stored(
        placed.groupBy("h", "r").agg(F.count(F.lit(1)).alias("size"), F.min("word").alias("word")), "spelling-reduced"
    )

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, other in neighbourhood(batch.column(0).to_pylist(), k):
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(other)], ["x", "h"])

    made = reduced.select("word").mapInArrow(generate, "x long, h long")
    met = made.join(reduced.select("h").hint("merge"), "h").select("x", F.col("h").alias("y")).distinct()
    same = reduced.filter("size > 1").select(F.col("h").alias("x"), F.col("h").alias("y"))
    pairs = stored(met.unionByName(same), "spelling-pairs")
    left = placed.select(F.col("h").alias("x"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = placed.select(F.col("h").alias("y"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    one_edit = F.levenshtein("a", "b", 1) == 1
    other = (F.col("x") != F.col("y")) | (F.col("a") < F.col("b"))
    sides = pairs.join(left, "x").withColumnRenamed("y", "_y")
    found = sides.join(right, (F.col("_y") == F.col("y")) & (F.length("a") - F.length("b")).between(-1, 1) & other & one_edit)
    return found.select(
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
        F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
    ).distinct()


# ---------------------------------------------------------------- groups


def group_variants(vocab: DataFrame, ratio: int = RATIO, k: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``vocab`` (word, n), one row a word.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that n is at least ``ratio`` times the
    word's, else NULL; ``root`` is the end of the chain of forms, the word itself without a form. Counts at least double
    along a chain, so it ends; its reach doubles in each round. No words give no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent, or chains may not end")
    vocab = stored(vocab, "spelling-vocabulary")
    pairs = stored(near_words(vocab, k), "spelling-near")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))
    )
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    likely = -F.col("best.m") >= ratio * F.col("n")
    formed = stored(
        vocab.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(likely, F.col("best.near")).alias("form"),
            F.when(likely, -F.col("best.m")).alias("form_n"),
        ),
        "spelling-forms",
    )
    reach = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = stored(
            reach.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")),
            "spelling-roots",
        )
        reach = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"roots did not settle in {ROUNDS} rounds")
    return formed.join(reach, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of all whole texts with their likely correct form; NULL and empty texts have none, repeated rows count again."""
    return group_variants(vocabulary(docs, id_col, text_col))
