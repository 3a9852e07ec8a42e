"""Language identification by rank-order n-gram profiles.

A language profile is the list of its most frequent character n-grams (1 to 3 characters, word ends
marked by a space) over all training texts. A document's own list is compared with each profile by the out-of-place
measure: the sum of rank differences, with the list length for n-grams that a profile lacks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecgrid.llm.common import bounded_batches, per_text

PROFILE = 400  # n-grams in a profile
UNKNOWN = "und"
_BLOCK = 1 << 20  # code points handled at once, which bounds memory on very long texts
_FLUSH = 2_000_000  # distinct n-grams that a training task holds before it passes its counts on
_SALTS = 16
_SPACE = 32
_LETTER: np.ndarray | None = None

#: A profile: n-gram codes in rank order.
Profiles = dict[str, np.ndarray]


def _letters() -> np.ndarray:
    """Which code points are letters, by code point."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of a whole text, codes ascending.

    The text is lower-cased, each run of other characters than letters is one space, and so are both ends. A code holds up
    to three code points of 21 bits; n-grams without a letter do not count.
    """
    text = (text or "").lower()
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    tail = np.full(1, _SPACE, np.int64)  # the last characters of the block before, a space at first
    for lo in range(0, len(text), _BLOCK):
        part = text[lo : lo + _BLOCK]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points = np.where(_letters()[points], points, _SPACE)
        if lo + _BLOCK >= len(text):
            points = np.append(points, _SPACE)
        fresh = np.concatenate([tail, points])
        keep = np.ones(len(fresh), bool)
        keep[1:] = (fresh[1:] != _SPACE) | (fresh[:-1] != _SPACE)
        old = int(keep[: len(tail)].sum())
        fresh = fresh[keep]
        one = fresh[old:]
        two = (fresh[:-1] << 21 | fresh[1:])[max(0, old - 1) :]
        in_word = fresh[1:-1] != _SPACE
        three = (fresh[:-2] << 42 | fresh[1:-1] << 21 | fresh[2:])[max(0, old - 2) :][in_word[max(0, old - 2) :]]
        grams = np.concatenate([one[one != _SPACE], two, three])
        found, n = np.unique(grams, return_counts=True)
        codes, counts = _merge([codes, found], [counts, n])
        tail = fresh[-2:]
    return codes, counts


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(codes), np.concatenate(counts)
    if not len(every):
        return every, n
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(n, first)


def ranking(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The ``k`` most frequent codes in order; equal counts go by code."""
    return codes[np.lexsort((codes, -counts))[:k]]


def fit_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", k: int = PROFILE) -> Profiles:
    """Profiles of all languages in ``lang_col``, counted over all rows and whole texts.

    Each task adds up its own counts; the rest is a grouped sum. The best ``k`` of each (language,
    salt) are cut in parallel, so at most 16 k n-grams of a language reach the driver. Rows with a NULL
    language, and NULL or letterless texts, add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = _merge(*zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"]
                )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = ngram_counts(text)
                held.setdefault(lang, []).append(found)
                size += len(found[0])
                if size > _FLUSH:
                    for key, parts in held.items():
                        held[key] = [_merge(*zip(*parts, strict=True))]
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > _FLUSH // 2:
                        yield from flush()
                        held, size = {}, 0
        yield from flush()

    bounded_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counted = rows.select(F.col(lang_col).cast("string"), F.col(text_col)).mapInArrow(run, "lang string, code long, n long")
    sums = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    salt = F.pmod(F.xxhash64("code"), F.lit(_SALTS)).alias("salt")
    best = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "code")
    top = sums.select("*", salt).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    by_lang: dict[str, list] = {}
    for r in top.select("lang", "code", "n").collect():
        by_lang.setdefault(r[0], []).append((r[1], r[2]))
    return {
        lang: ranking(np.array([c for c, _ in got], np.int64), np.array([n for _, n in got], np.int64), k)
        for lang, got in sorted(by_lang.items())
    }


def identify(profiles: Profiles, k: int = PROFILE) -> Callable[[str | None], tuple[str, float]]:
    """text -> (language, score): the profile with the least out-of-place distance, ties to the smaller name.

    The score is 1 - distance / largest possible distance. Without a letter, or without profiles: ``und``, 0.
    """
    names = sorted(profiles)
    orders = [np.argsort(profiles[n], kind="stable") for n in names]
    sorted_codes = [profiles[n][o] for n, o in zip(names, orders, strict=True)]

    def one(text: str | None) -> tuple[str, float]:
        codes, counts = ngram_counts(text)
        if not len(codes) or not names:
            return UNKNOWN, 0.0
        own = ranking(codes, counts, k)
        place = np.arange(len(own))
        totals = []
        for at, order in zip(sorted_codes, orders, strict=True):
            if not len(at):
                totals.append(k * len(own))
                continue
            pos = np.minimum(np.searchsorted(at, own), len(at) - 1)
            out = np.where(at[pos] == own, np.abs(order[pos] - place), k)
            totals.append(int(out.sum()))
        best = int(np.argmin(totals))
        return names[best], 1 - totals[best] / (k * len(own))

    return one


SCHEMA = "lang_pred string, score double"


def predictor(profiles: Profiles, k: int = PROFILE) -> Callable[[Column], Column]:
    """Column function: struct of ``lang_pred`` and ``score`` (0 to 1) of whole texts.

    NULL, empty and letterless texts are ``und`` with score 0.
    """

    def make():
        one = identify(profiles, k)

        def batch(texts: pa.Array) -> list[pa.Array]:
            got = [one(t) for t in texts.to_pylist()]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

        return batch

    return per_text(make, SCHEMA)


def keep_languages(
    docs: DataFrame, profiles: Profiles, wanted: set[str] | None = None, min_score: float = 0.0, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` in a wanted language (None: any learned one) with at least ``min_score``, columns as they are.

    Documents in no language, ``und``, go.
    """
    names = sorted(profiles if wanted is None else wanted)
    got = docs.withColumn("_llm_lang", predictor(profiles)(F.col(text_col)))
    ok = F.col("_llm_lang.lang_pred").isin(names) & (F.col("_llm_lang.score") >= min_score)
    return got.filter(ok).select(*[got[c] for c in docs.columns])
