"""SimHash near-dedup with pigeonring candidate filtering.

A 64-bit fingerprint is cut into ``SEGMENTS`` segments in a ring. If two fingerprints
differ in at most r bits, some segment starts a chain along the ring in which, for every length
l, the first l segments differ in at most floor(l * r / m) bits together (the
pigeonring principle). Candidates are found by an equi-join on the exact part of such a chain and
must pass the budgets of all its lengths before the full distance is taken.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgrid.llm.common import per_text, sized, stored
from vecgrid.llm.components import components

SHINGLE, SEED, RADIUS, SEGMENTS = 3, 42, 2, 5
_SLICE = 1 << 16  # words handled at once, which bounds memory on very long texts
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint: a bit is set if more than half of the shingle hashes have it.

    A-Z is lower-cased, words are runs without ASCII white space, shingles keep repeats; a text of fewer
    words is one shingle; one without words (or NULL) gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total, counts = 0, np.zeros(64, np.int64)
    for lo in range(0, max(1, len(words) - shingle + 1), _SLICE):
        part = words[lo : lo + _SLICE + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = max(1, len(part) - shingle + 1)
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        counts += bit_counts(hashes)
        total += n
    bits = (2 * counts > total).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits: byte lanes are summed, at most 255 hashes at a time."""
    n = -(-len(hashes) // 255) * 255
    rows = np.concatenate([hashes, np.zeros(n - len(hashes), np.uint64)]).reshape(-1, 255)
    out = np.empty((8, 8), np.int64)
    for k in range(8):
        lanes = ((rows >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
        out[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.ravel()


def _batch_maker(shingle: int, seed: int) -> Callable[[], Callable[[pa.Array], list[pa.Array]]]:
    def make():
        def batch(texts: pa.Array) -> list[pa.Array]:
            found = np.array([fingerprint(t, shingle, seed) for t in texts.to_pylist()], np.uint64)
            return [pa.array(found.view(np.int64))]

        return batch

    return make


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, ``fp``): the fingerprint of each whole text, as a signed long."""
    return docs.select(F.col(id_col), fingerprinter(shingle)(F.col(text_col)).alias("_r")).select(id_col, "_r.fp")


def fingerprinter(shingle: int = SHINGLE) -> Callable[[Column], Column]:
    """A column function of a text column: a struct with its fingerprint as ``fp``, a signed long."""
    return per_text(_batch_maker(shingle, SEED), "fp long")


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    """Bit masks of ``segments`` nearly equal runs of the 64 bits."""
    at = [64 * i // segments for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(at, at[1:], strict=False)]


def _long(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def chain_keys(radius: int = RADIUS, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(start, mask) of the exact parts of all chains.

    The segments whose budget is still 0 must agree exactly. The next one may differ in ``b`` bits, so of
    b + 1 parts of it one must agree; each part makes a key of its own, which keeps buckets small.
    """
    masks, out = segment_masks(segments), []
    exact = next(n for n in range(1, segments + 2) if n * radius // segments > 0) - 1
    for start in range(segments):
        ring = [masks[(start + k) % segments] for k in range(segments)]
        base = sum(ring[:exact])
        if exact >= segments:
            out.append((start, base))
            continue
        parts = (exact + 1) * radius // segments + 1
        bits = [b for b in range(64) if ring[exact] >> b & 1]
        for p in range(parts):
            out.append((start, base | sum(1 << b for b in bits[p::parts])))
    return out


def viable(x: Column, start: int, radius: int = RADIUS, segments: int = SEGMENTS) -> Column:
    """Whether the bits ``x`` (xor of two fingerprints) keep within the budget of every chain length from ``start``."""
    masks = segment_masks(segments)
    ok, chain = F.lit(True), 0
    for length in range(1, segments + 1):
        chain |= masks[(start + length - 1) % segments]
        ok = ok & (F.bit_count(x.bitwiseAND(_long(chain))) <= length * radius // segments)
    return ok


def links(nodes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct values in column ``fp`` that differ in at most ``radius`` bits.

    Each value makes one row per chain key; rows with an equal key meet in a shuffle join of a table with
    itself and are tested against the chain's budgets in generated code. No bucket is capped:
    within a bucket the values are distinct, and a large bucket can be split by adaptive execution.
    """
    keys = chain_keys(radius, segments)
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(start).alias("s"), F.col("fp").bitwiseAND(_long(mask)).alias("v"))
            for k, (start, mask) in enumerate(keys)
        ]
    )
    rows = stored(nodes.select("fp", F.explode(entries).alias("e")).select("e.*", "fp"), "chain-keys", "lz4")
    left, right = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    budgets = F.lit(False)
    for start in range(segments):
        budgets = budgets | ((F.col("s") == start) & viable(x, start, radius, segments))
    met = left.join(right.hint("merge"), ["k", "s", "v"]).filter(F.col("a") < F.col("b")).filter(budgets)
    return met.filter(F.bit_count(x) <= radius).select("a", "b").distinct()


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, segments: int = SEGMENTS
) -> DataFrame:
    """(id, ``fp`` long, ``component_id``): for each row the smallest id reachable over links of ``radius`` bits.

    Rows with equal fingerprints, repeated rows included, are one node, made by an aggregation that
    combines before it shuffles, so groups of copies of any size cost one row per task. NULL and empty texts
    have fingerprint 0 and are linked like any other. NULL ids take part, but are never the
    smallest id unless a component has no other. No rows give no rows; other columns are not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col).select(F.col(id_col).alias("_id"), "fp"), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("_id").alias("least")), "fp-nodes")
    roots = components(links(nodes, radius, segments))
    rooted = stored(
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "fp-roots",
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(smallest, "root").select("fp", "component_id"), "fp-components")
    return rows.join(named.hint("merge"), "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp: str | Column = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[..., DataFrame] = near_groups
) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their near-duplicate group, columns as they are.

    ``groups`` finds the groups: ``near_groups`` by fingerprints, or ``shingle_join.near_groups`` by exact similarity.
    An id stays if any of its rows leads a group; of rows that repeat an id, one stays. Rows with a NULL id
    stay (as one) only if they lead a group without any other id.
    """
    verdict = groups(docs, id_col, text_col)
    by_id = stored(
        verdict.groupBy(F.col(id_col).alias("_lost_id")).agg(
            F.max(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("leads"), F.count(F.lit(1)).alias("n")
        ),
        "near-ids",
    )
    lost = sized(by_id.filter("NOT leads").select("_lost_id"))
    kept = docs.join(lost, F.col(id_col).eqNullSafe(F.col("_lost_id")), "left_anti")
    return kept if by_id.filter("leads AND n > 1").isEmpty() else kept.dropDuplicates([id_col])
