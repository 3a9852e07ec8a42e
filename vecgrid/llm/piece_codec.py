"""SentencePiece encoding and decoding for merge-type vocabularies.

Symbols start as single characters. An agenda (heap) holds the adjacent pairs that make a piece, best score first and
leftmost among equals; the best is merged and the pairs it makes with its neighbours join the agenda. Characters that
are no piece become their UTF-8 bytes. The vocabulary's pieces never hold a space mark after another character, so no merge
crosses the start of a word and a word is encoded once for as long as a bounded memo holds it. New words are checked
against the library as they come up in an Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column

from vecgrid.llm.common import MEMO_BYTES, Memo, per_text, ragged_take, slices
from vecgrid.llm.common import words as cut_words

MARK = "▁"
_SHORT = 48  # longer words are merged one by one
_WORDS, _SLICE = 200_000, 1 << 20  # words and characters handled at once


class PieceCodec:
    """Encoder and decoder of one model file. Raises ValueError for models that it does not cover."""

    def __init__(self, path: str, check: bool = True, memo: int = MEMO_BYTES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library, self.check = model, check
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        ordinary = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if ordinary[i]}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("only merge-type vocabularies with byte pieces and without pieces across words are covered")
        probe = " a  b\t\n ａ é "
        if model.decode(model.encode(probe)) != probe or model.encode(probe, out_type=str)[0][0] != MARK:
            raise ValueError("only models that leave text as it is and put a space before it are covered")
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.text = [
            bytes([int(pieces[i][3:5], 16)])
            if model.is_byte(i)
            else pieces[i].replace(MARK, " ").encode()
            if ordinary[i]
            else (b"" if model.is_control(i) else " ⁇ ".encode())
            for i in range(n)
        ]
        self.known = Memo(self._encode, memo)
        self.odd: set[str] = set()  # words that their pieces do not give back
        if any("\n" in p for p in self.ids):
            raise ValueError("only vocabularies without pieces across lines are covered")
        self.mismatches = 0
        # the same agenda as arrays: symbols are pieces and the single characters of pieces
        symbols = dict.fromkeys([*self.ids, *(ch for p in self.ids for ch in p)])
        number = {p: k for k, p in enumerate(symbols)}
        self.size = len(number)
        self.symbol_id = np.array([self.ids.get(p, -1) for p in number], np.int64)
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, k in number.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
        merges = [
            (number[p[:c]] * self.size + number[p[c:]], self.scores[p], number[p])
            for p in self.ids
            for c in range(1, len(p))
            if p[:c] in number and p[c:] in number
        ]
        merges.sort()
        self.pairs = np.array([m[0] for m in merges] or [-1], np.int64)
        self.pair_scores = np.array([m[1] for m in merges] or [0.0])
        self.pair_makes = np.array([m[2] for m in merges] or [0], np.int64)

    _words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
    _start = re.compile(f"(?<=[^{MARK}]){MARK}")

    def merge(self, word: str) -> list[int]:
        """Ids of one word (space marks, then other characters) by the agenda."""
        scores = self.scores
        symbols: list[str | None] = list(word)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = word[i : i + 2]
            if pair in scores:
                agenda.append((-scores[pair], i, pair))
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            a = symbols[i]
            j = right[i]
            # an entry is stale unless both symbols are still those that make the pair
            if a is None or j >= n or len(a) + len(symbols[j]) != len(pair) or a + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                new = pair + symbols[k]
                if new in scores:
                    heappush(agenda, (-scores[new], i, new))
            h = left[i]
            if h >= 0:
                new = symbols[h] + pair
                if new in scores:
                    heappush(agenda, (-scores[new], h, new))
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.bytes[b] for b in s.encode())
        return out

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, merged symbol) of pairs of symbols; -inf where they make no piece."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        ok = (self.pairs[at] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, self.pair_scores[at], -np.inf), self.pair_makes[at]

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many words of one length at once: in each round every word merges the best pair of its agenda.

        Returns (ids as rows, number of ids of each word); the number is -1 where a character needs its bytes.
        """
        width = len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, width)
        symbols = self.of_char[points]
        sizes = np.full(len(words), width)
        score, makes = (
            self._look_up(symbols[:, :-1], symbols[:, 1:]) if width > 1 else (np.full((len(words), 0), -np.inf),) * 2
        )
        live = np.arange(len(words))
        columns = np.arange(width)
        while len(live) and width > 1:
            best = score[live].argmax(axis=1)
            top = score[live, best]
            live, best = live[top > -np.inf], best[top > -np.inf]
            if not len(live):
                break
            made = makes[live, best]
            # take the right-hand symbol out and close the gap
            step = np.minimum(columns + (columns > best[:, None]), width - 1)
            rows = np.take_along_axis(symbols[live], step, 1)
            rows[:, -1] = -1
            rows[np.arange(len(live)), best] = made
            symbols[live] = rows
            step = np.minimum(columns[:-1] + (columns[:-1] > best[:, None]), width - 2)
            scores, products = np.take_along_axis(score[live], step, 1), np.take_along_axis(makes[live], step, 1)
            scores[:, -1] = -np.inf
            here = np.arange(len(live))
            sizes[live] -= 1
            for at in (best - 1, best):  # the pairs that the new symbol makes with its neighbours
                ok = (at >= 0) & (at < width - 1)
                k, c = here[ok], at[ok]
                scores[k, c], products[k, c] = self._look_up(rows[k, c], rows[k, c + 1])
            score[live], makes[live] = scores, products
        ids = np.where(symbols >= 0, self.symbol_id[symbols], -1)
        plain = ((ids >= 0) | (columns >= sizes[:, None])).all(axis=1)
        return ids, np.where(plain, sizes, -1)

    def slices(self, text: str) -> Iterator[list[str]]:
        """The words of a text with its leading space, cut before every run of space marks; long texts in several lists."""
        text, at = MARK + text.replace(" ", MARK), 0
        while at < len(text):
            cut = self._start.search(text, at + _SLICE)
            stop = cut.start() if cut else len(text)
            yield self._words.findall(text, at, stop)
            at = stop

    def _encode(self, words: list[str]) -> list[bytes]:
        """Packed ids of different words, checked against the library, all of a length at once."""
        out: dict[str, bytes] = {"": b""}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        by_length.pop(0, None)
        for length, fresh in by_length.items():
            lib = self._ask(fresh)
            if length > _SHORT:
                for w, theirs in zip(fresh, lib, strict=True):
                    out[w] = self._settle(w, self.merge(w), theirs)
                continue
            rows, sizes = self.merge_all(fresh)
            known = np.arange(length) < sizes[:, None]
            if (sizes >= 0).all() and (
                not self.check
                or (sizes == np.fromiter(map(len, lib), np.int64, len(lib))).all()
                and (rows[known] == np.fromiter(chain.from_iterable(lib), np.int64)).all()
            ):
                if "".join(fresh).replace(MARK, " ").encode() == b"".join([self.text[i] for i in rows[known].tolist()]):
                    packed, step = rows.astype("<u4").tobytes(), 4 * length
                    out.update((w, packed[k * step : k * step + 4 * n]) for k, (w, n) in enumerate(zip(fresh, sizes.tolist(), strict=True)))
                    continue
            for w, row, n, theirs in zip(fresh, rows.tolist(), sizes.tolist(), lib, strict=True):
                out[w] = self._settle(w, row[:n] if n >= 0 else self.merge(w), theirs)
        return [out[w] for w in words]

    def _ask(self, words: list[str]) -> list[list[int]]:
        """The library's ids of words. It puts a space before a text, so a mark is taken off; a word without one is asked
        for after a line end, which no piece crosses."""
        if not self.check:
            return [[]] * len(words)
        asked = [w[1:].replace(MARK, " ") if w[0] == MARK else "\n" + w for w in words]
        got = self.library.encode(asked, num_threads=1)
        return [ids if w[0] == MARK else ids[2:] for w, ids in zip(words, got, strict=True)]

    def _settle(self, word: str, mine: list[int], theirs: list[int]) -> bytes:
        if self.check and mine != theirs and word != MARK:  # a lone mark can't be asked for
            self.mismatches += 1
            mine = theirs
        if b"".join([self.text[i] for i in mine]) != word.replace(MARK, " ").encode():
            self.odd.add(word)
        return struct.pack(f"<{len(mine)}I", *mine)

    def encode_batch(self, texts: pa.Array) -> Iterator[tuple[bytes, str]]:
        """(ids with begin and end as little-endian unsigned 32-bit integers, decoded text) of each text."""
        head, tail = (x.to_bytes(4, "little") for x in (self.begin, self.end))
        for part in slices(texts):
            # marks before words, cuts at single spaces and around line ends
            marked = pc.binary_join_element_wise(MARK, pc.replace_substring(part, " ", f" {MARK}"), "")
            different, number, at = cut_words(pc.replace_substring(marked, "\n", " \n "), " ")
            ids = self.known.of(different)
            # texts with runs of spaces, spaces at an end, or marks of their own are encoded one by one
            rare = np.array([w == MARK or w in self.odd for w in different])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            taken = sizes[number]
            flat = ragged_take(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(sizes) - sizes)[number], taken)
            bounds = np.concatenate([[0], np.cumsum(taken)])[at].tolist()
            slow = np.logical_or.reduceat(rare[number], at[:-1])
            slow |= pc.match_substring(part, MARK).to_numpy(zero_copy_only=False)
            for text, a, b, alone in zip(part.to_pylist(), bounds, bounds[1:], slow.tolist(), strict=False):
                own = self._one(text) if alone else flat[a:b].tobytes()
                yield head + own + tail, self.decode(own) if alone else text

    def _one(self, text: str) -> bytes:
        out = []
        for words in self.slices(text) if text else ():
            for lo in range(0, len(words), _WORDS):
                some = words[lo : lo + _WORDS]
                different = list(dict.fromkeys(some))
                ids = dict(zip(different, self.known.of(different), strict=True))
                out.append(b"".join([ids[w] for w in some]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids without begin and end; the space that encoding puts before a text is taken off."""
        raw = b"".join([self.text[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw.removeprefix(b" ").decode("utf-8", "replace")


SCHEMA = "n_tokens long, ids binary, decoded string, ids_sha256 string, decoded_sha256 string, mismatches long"


def codec(path: str, check: bool = True, with_texts: bool = True) -> Callable[[Column], Column]:
    """Column function: struct of ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers, begin and end included),
    ``decoded``, the SHA-256 of both in lower-case hex, and ``mismatches``, the words of the task so far that the
    library encodes otherwise (its ids are then used). Without ``with_texts`` the first two outputs are NULL.

    Whole texts are encoded; NULL is the empty text, whose ids are begin and end alone and which decodes to itself.
    """

    def make():
        it = PieceCodec(path, check)

        def batch(texts: pa.Array) -> list[pa.Array]:
            ids, decoded = zip(*it.encode_batch(texts), strict=True) if len(texts) else ((), ())
            none = [None] * len(texts)
            return [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array(ids if with_texts else none, pa.binary()),
                pa.array(decoded if with_texts else none, pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                pa.array([it.mismatches] * len(texts), pa.int64()),
            ]

        return batch

    return per_text(make, SCHEMA)
