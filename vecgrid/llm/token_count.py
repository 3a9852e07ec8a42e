"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie whose failure links lead to the node that matching goes on from once the longest pieces
of what was read have been taken off; how many these are is stored beside the link. A word is then one walk over its
characters that adds up stored numbers: no piece is built and no character is read twice.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecgrid.llm.common import Memo, per_text, slices, words

MAX_WORD = 100  # default: a longer word counts as one unknown token, as the tokenisers library has it; the query has no bound
_MEMO_CHARS = 100  # longer words are counted each time, so that the memo stays small


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that begin a word and pieces that carry one on (without their marker)."""

    initial: frozenset[str]
    continuing: frozenset[str]

    @staticmethod
    def of(pieces: Iterable[str], marker: str = "##") -> Vocabulary:
        """From word pieces in which those that carry a word on begin with ``marker``."""
        every = list(pieces)
        return Vocabulary(
            frozenset(p for p in every if p and not p.startswith(marker)),
            frozenset(p[len(marker) :] for p in every if p.startswith(marker) and len(p) > len(marker)),
        )

    @staticmethod
    def of_piece_model(path: str) -> Vocabulary:
        """From a sentencepiece model: pieces after one space mark begin a word, those without one carry it on."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = [model.id_to_piece(i) for i in ids]
        return Vocabulary(
            frozenset(p[1:] for p in pieces if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]),
            frozenset(p for p in pieces if "▁" not in p),
        )


class Automaton:
    """Trie with failure links and popped-token counts.

    Node 0 is the start of a word, node 1 the start after a taken piece. ``fail[v]`` is -1 where no piece
    fits, else the node to go on from after ``pops[v]`` pieces have been taken.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        parent: list[tuple[int, str]] = [(-1, ""), (-1, "")]
        for root, pieces in ((0, vocabulary.initial), (1, vocabulary.continuing)):
            for piece in pieces:
                v = root
                for ch in piece:
                    w = self.next[v].get(ch)
                    if w is None:
                        w = self.next[v][ch] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                        parent.append((v, ch))
                    v = w
                ends[v] = True
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        todo = deque([0, 1])
        while todo:  # breadth first, so a node's link is there before its children need it
            v = todo.popleft()
            todo.extend(self.next[v].values())
            u, ch = parent[v]
            if u < 0:
                continue
            if ends[v]:
                self.fail[v], self.pops[v] = 1, 1
                continue
            z, popped = self.fail[u], self.pops[u]
            while z >= 0 and ch not in self.next[z]:
                popped += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.next[z][ch], popped

    def count(self, word: str) -> int:
        """Number of pieces of a word by greedy longest match; 0 if it can't be cut into pieces."""
        follow, fail, pops = self.next, self.fail, self.pops
        v = taken = 0
        for ch in word:
            w = follow[v].get(ch)
            while w is None:
                if fail[v] < 0:
                    return 0
                taken += pops[v]
                v = fail[v]
                w = follow[v].get(ch)
            v = w
        while v != 1:
            if fail[v] < 0:
                return 0
            taken += pops[v]
            v = fail[v]
        return taken


SCHEMA = "n_words long, n_tokens long, n_unknown long"


def counter(make_vocabulary: Callable[[], Vocabulary], max_word: int | None = MAX_WORD) -> Callable[[Column], Column]:
    """Column function: struct of ``n_words`` (runs without white space), ``n_tokens`` and ``n_unknown``, the words
    that are one unknown token: those that can't be cut into pieces or are longer than ``max_word``.

    Whole texts are counted. NULL, empty and blank texts give zeros. Words with white space inside do not exist, so
    texts are never normalised otherwise. White space is that of Unicode.
    """

    def make():
        automaton = Automaton(make_vocabulary())

        def one(word: str) -> int:
            return automaton.count(word) if max_word is None or len(word) <= max_word else 0

        known = Memo(lambda fresh: [one(w) if w else -1 for w in fresh])

        def counts_of(different: list[str]) -> list[int]:
            out = known.of([w if len(w) <= _MEMO_CHARS else "" for w in different])
            return [n if len(w) <= _MEMO_CHARS else one(w) for n, w in zip(out, different, strict=True)]

        def batch(texts: pa.Array) -> list[pa.Array]:
            out = [np.zeros((0, 3), np.int64)]
            for part in slices(texts):
                different, number, at = words(part)
                counts = np.array(counts_of(different), np.int64)
                kinds = np.stack([counts >= 0, np.where(counts == 0, 1, counts) * (counts >= 0), counts == 0], axis=1)
                sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(kinds[number], axis=0)])
                out.append(sums[at[1:]] - sums[at[:-1]])
            return [pa.array(column) for column in np.concatenate(out).T.copy()]

        return batch

    return per_text(make, SCHEMA)


def count_tokens(
    docs, make_vocabulary: Callable[[], Vocabulary], id_col: str = "doc_id", text_col: str = "text", max_word: int | None = MAX_WORD
):
    """(id, n_words, n_tokens, n_unknown) for each row, ids NULL or repeated included; other columns are not read."""
    return docs.select(F.col(id_col), counter(make_vocabulary, max_word)(F.col(text_col)).alias("_r")).select(id_col, "_r.*")
