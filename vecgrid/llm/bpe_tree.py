"""Byte-level BPE as a monoid: encodings of neighbours are joined up a tree.

A piece of bytes is encoded by halves. Two encodings are joined by looking at their border: if the last token of one and the
first of the other stay as they are when both are encoded together, nothing else changes either; if not, a window of tokens on
both sides is encoded again and grows until the tokens outside are stable.

Why two tokens are enough: a merge across a border needs some end of the left token and some beginning of the right one as they
are at one moment of merging in rank order. Inside a token that moment looks alike whether the rest of the text is there or not,
since no merge crosses the token's own borders. So a sequence of tokens is the encoding of its bytes if, and only if,
each two neighbours are the encoding of theirs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecgrid.llm.common import Memo, SpaceCutEncoder, per_text, ragged_take

LEAF_BYTES = 16  # pieces up to this length are merged directly
LEAF_IDS = 1 << 15  # ids decoded at once
_HELD = 50_000  # borders that are remembered, in each of two generations
_SHORT = 64  # bytes of the longest window that is merged without an agenda
_NONE = 1 << 40  # rank of a pair that makes no token
MEMO = 80 << 20  # bytes of the memo of words
_PIECES = 4096  # pieces of one text that are held at a time


class Recent(dict):
    """Values of ``fn`` by key; of those that were not asked for lately at most ``_HELD`` are kept."""

    def __init__(self, fn: Callable):
        super().__init__()
        self.fn, self.old = fn, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= _HELD:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class BytePairTree:
    """Encoder and decoder by a table of ranks: byte strings to ids, which are the order of merging as well.

    Leaves and windows of a few bytes go through the library's merge loop, which is the same as ``merge`` but for tokens that
    no merges lead to: it gives these for a piece that is one of them. They are listed once and merged here.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.token: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.sizes = np.fromiter(map(len, self.token), np.int64, size)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self._stable = Recent(self._stay)
        import tiktoken

        self._small = tiktoken.Encoding("tree", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.unreachable = frozenset(t for t, rank in ranks.items() if len(t) > 1 and self._merge_here(t) != [rank])

    # encoding

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern. A piece that is a token is that token, as in the library."""
        whole = self.ranks.get(piece)
        return self.tree(piece) if whole is None else [whole]

    def tree(self, data: bytes) -> list[int]:
        """Ids of ``data`` by halves: the leaves are merged directly, then neighbours are joined level by level."""
        merge, stable, join = self._small if not self.unreachable else self.merge, self._stable, self.join
        level = [merge(data[k : k + LEAF_BYTES]) for k in range(0, len(data), LEAF_BYTES)]
        while len(level) > 1:
            odd = [level[-1]] if len(level) % 2 else []
            pairs = zip(level[::2], level[1::2], strict=False)
            level = [a + b if stable[a[-1], b[0]] else join(a, b) for a, b in pairs] + odd
        return level[0] if level else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the bytes of both."""
        if not left or not right or self._stable[left[-1], right[0]]:
            return left + right
        token, stable = self.token, self._stable
        i = j = 1
        while True:
            window = self.merge(b"".join([token[t] for t in left[-i:] + right[:j]]))
            ok_left = i == len(left) or stable[left[-i - 1], window[0]]
            ok_right = j == len(right) or stable[window[-1], right[j]]
            if ok_left and ok_right:
                return left[:-i] + window + right[j:]
            i, j = i if ok_left else min(2 * i, len(left)), j if ok_right else min(2 * j, len(right))

    def _stay(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens, encoded together, stay as they are."""
        both = self.token[pair[0]] + self.token[pair[1]]
        return both not in self.ranks and self.merge(both) == list(pair)

    def merge(self, data: bytes) -> list[int]:
        """Ids of ``data`` by merging neighbours, the pair of lowest rank first, of equal ones the leftmost."""
        if len(data) > _SHORT:
            return self._merge_long(data)
        return self._merge_here(data) if not data or data in self.unreachable else self._small(data)

    def _merge_here(self, data: bytes) -> list[int]:
        rank = self.ranks.get
        parts = [data[k : k + 1] for k in range(len(data))]
        pairs = [rank(data[k : k + 2], _NONE) for k in range(len(data) - 1)]
        while pairs and (least := min(pairs)) != _NONE:
            at = pairs.index(least)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], _NONE)
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], _NONE)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """``merge`` with an agenda of pairs, for long windows."""
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # of the part that begins here; 0 once it is inside another
        before = list(range(-1, n - 1))
        agenda = [(r, k, k + 1, k + 2) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, a, b, stop = heappop(agenda)
            if end[a] != b or b >= n or end[b] != stop:
                continue
            end[a], end[b] = stop, 0
            if stop < n:
                before[stop] = a
                rank = ranks.get(data[a : end[stop]])
                if rank is not None:
                    heappush(agenda, (rank, a, stop, end[stop]))
            if a:
                rank = ranks.get(data[before[a] : stop])
                if rank is not None:
                    heappush(agenda, (rank, before[a], a, stop))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return out

    # decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids: those of the halves, one after the other."""
        if len(ids) <= LEAF_IDS:
            return ragged_take(self.flat, self.starts[ids], self.sizes[ids]).tobytes()
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class TreeCodec(SpaceCutEncoder):
    """Whole texts to packed ids: each match of ``pattern`` is encoded by ``tree``, different words once while the memo holds them."""

    def __init__(self, tree: BytePairTree, pattern: str, memo: int = MEMO):
        super().__init__(memo)
        self.tree, self.pattern = tree, regex.compile(pattern)
        self.pieces = Memo(lambda fresh: [self._packed(tree.encode(p.encode())) for p in fresh], memo // 8)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _encode(self, fresh: list[str]) -> list[bytes]:
        """Ids of words that follow a space; a match is a leaf of its own, so matches are only put in a row."""
        encode, cut = self.tree.encode, self.pattern.findall
        out: list[int] = []
        ends: list[int] = []
        for w in fresh:
            if w.isalpha():  # letters are one match with their space
                out += encode(b" " + w.encode())
            else:
                for piece in cut(" " + w):
                    out += encode(piece.encode())
            ends.append(4 * len(out))
        packed = self._packed(out)
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _alone(self, text: str) -> bytes:
        out, held = [], []
        for match in self.pattern.finditer(text):
            held.append(match.group())
            if len(held) == _PIECES:
                out.append(b"".join(self._known(held)))
                held = []
        return b"".join([*out, *self._known(held)])

    def _known(self, pieces: list[str]) -> list[bytes]:
        different = list(dict.fromkeys(pieces))
        ids = dict(zip(different, self.pieces.of(different), strict=True))
        return [ids[p] for p in pieces]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with one token in base64 and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=1)
def tree_of(path: str) -> BytePairTree:
    """The tree of a file of ranks, made once in a worker."""
    return BytePairTree(read_ranks(path))


SCHEMA = "n_tokens long, ids binary, decoded binary, ids_sha256 string, decoded_sha256 string"


def codec(path: str, pattern: str, with_values: bool = True) -> Callable[[Column], Column]:
    """Column function: struct of ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers), ``decoded`` (the bytes that
    the ids stand for) and the SHA-256 in lower-case hex of the ids as decimal numbers joined by commas and of the decoded
    bytes. Without ``with_values`` the second and third are NULL.

    Whole texts are encoded, each match of ``pattern`` by itself and without special tokens. NULL is the empty text, which has no ids.
    """

    def make():
        tree = tree_of(path)
        encode = TreeCodec(tree, pattern)
        decimal = [str(k) for k in range(len(tree.token))]

        def rows(texts: pa.Array) -> Iterator[tuple]:
            for packed in encode(texts):
                ids = np.frombuffer(packed, "<u4")
                decoded = tree.decode(ids)
                written = ",".join(map(decimal.__getitem__, ids.tolist()))
                values = (packed, decoded) if with_values else (None, None)
                yield len(ids), *values, hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

        def batch(texts: pa.Array) -> list[pa.Array]:
            columns = list(zip(*rows(texts), strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string())
            return [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]

        return batch

    return per_text(make, SCHEMA)


def encode_documents(docs, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_values: bool = True):
    """(id, n_tokens, ids, decoded, ids_sha256, decoded_sha256) of each row, ids NULL or repeated included; other columns are not read."""
    got = docs.select(F.col(id_col), codec(path, pattern, with_values)(F.col(text_col)).alias("_r"))
    return got.select(id_col, "_r.*")
