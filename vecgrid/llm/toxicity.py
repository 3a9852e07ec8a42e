"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has probability sigmoid(bias + sum of its words' scores),
the document is toxic if any sentence is: 1 - prod(1 - p), a noisy-or. Only document
labels are needed to learn; the sentence probabilities then say where the offence is.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgrid.llm.common import Memo, bounded_batches, per_text, ragged_take, slices, spans, stored, text_of, words

FEATURES = 1 << 18  # hash places of features while a model is fitted
SENTENCE_WORDS = 40  # a longer run without an end of sentence is cut after so many tokens
START_BIAS = -9.0
MAX_TRAIN_DOCS = 10_000  # bound of the labelled sample that a model is fitted on
MAX_TRAIN_CHARS = 60_000  # longer texts are not drawn into that sample; all are scored
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the word features that tell, and the bias of a sentence."""

    weights: dict[str, float]
    bias: float

    def word_score(self, word: str) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in word_features(word)])


def word_features(word: str) -> list[str]:
    """The word itself and its different character runs of 4 to 6 with its ends marked, in a fixed order."""
    marked = f"<{word}>"
    n = len(marked)
    runs = [marked[i : i + size] for size in (4, 5, 6) for i in range(n - size + 1)]
    return list(dict.fromkeys([f"={word}", *runs]))


def _hashed(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % FEATURES for f in features]


def sentence_numbers(ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence of each token, document of each sentence) for the tokens of documents that begin at ``at``.

    A sentence ends with a token for which ``ends`` is set, with its document, or after ``SENTENCE_WORDS`` tokens. A document
    without tokens has none.
    """
    n = len(ends)
    first = np.zeros(n + 1, bool)
    first[1:] = ends
    first[at[:-1]] = True
    first = first[:n]
    place = np.arange(n)
    begin = np.maximum.accumulate(np.where(first, place, 0))
    first = first | ((place - begin) % SENTENCE_WORDS == 0)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.cumsum(first) - 1, doc[first]


def ends_sentence(token: str) -> bool:
    return token.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", "…", "。")


def bags(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(different words, document of each sentence, sentence and word of each pair); a word counts once in a sentence."""
    different, token, at = words(texts)
    vocabulary: dict[str, int] = {}
    inside, sizes = array("i"), np.zeros(len(different), np.int64)
    for k, t in enumerate(different):
        found = _WORD.findall(t.lower())
        sizes[k] = len(found)
        inside.extend([vocabulary.setdefault(w, len(vocabulary)) for w in found])
    ends = np.fromiter(map(ends_sentence, different), bool, len(different))
    sentence, doc = sentence_numbers(ends[token], at)
    word = ragged_take(np.frombuffer(inside, np.int32), (np.cumsum(sizes) - sizes)[token], sizes[token])
    pairs = np.unique(np.repeat(sentence, sizes[token]) << 32 | word)
    return list(vocabulary), doc, pairs >> 32, pairs & 0xFFFFFFFF


def word_counts(texts: pa.Array, toxic: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, toxic documents with it, documents with it), one batch for each slice of the texts."""
    for first, n in spans(texts):
        found, doc, sentence, word = bags(pc.fill_null(texts.slice(first, n), ""))
        by_doc = np.unique(doc[sentence] << 32 | word)
        of_doc, word = toxic[first : first + n][by_doc >> 32], by_doc & 0xFFFFFFFF
        columns = [pa.array(found, pa.string()), *(np.bincount(w, minlength=len(found)) for w in (word[of_doc], word))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "toxic", "every"])


def sentence_words(texts: pa.Array, known: dict[str, int]) -> Iterator[pa.StructArray]:
    """For each text the number of its sentences and the pairs of a sentence, from 0, and the number of a known word in it."""
    for first, n in spans(texts):
        found, doc, sentence, word = bags(pc.fill_null(texts.slice(first, n), ""))
        number = np.array([known.get(w, -1) for w in found], np.int32)[word] if found else np.empty(0, np.int32)
        sentence, number = sentence[number >= 0], number[number >= 0]
        begin = np.searchsorted(doc, np.arange(n + 1))
        own = (sentence - begin[doc[sentence]]).astype(np.int32)
        cuts = pa.array(np.searchsorted(doc[sentence], np.arange(n + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (own, number)]
        yield pa.StructArray.from_arrays([pa.array(np.diff(begin).astype(np.int32)), *lists], names=["n", "sentence", "word"])


FIT_TASKS = 24  # that cut the labelled sample into words


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", order_col: str = "_order") -> ToxicityModel:
    """Fit on ``labelled``, a sample that the caller has bounded (see ``training_sample``); rows with a NULL label are left out.

    Tasks cut the texts. The driver gets the counts of the sample's different words, then, of each text, the sentences with
    the words that tell; it never holds a text.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.filter(F.col(label_col).isNotNull()).select(
        F.col(order_col).alias("o"), F.col(label_col).cast("double").alias("y"), text_of(text_col).alias("t")
    )
    rows = stored(rows.repartition(FIT_TASKS), "toxicity-sample")
    n, total, low, high = rows.agg(F.count("*"), F.sum("y"), F.min("y"), F.max("y")).first()
    if n == 0 or low == high:
        return _constant(n, total or 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from word_counts(b.column("t"), b.column("y").to_numpy() > 0.5)

    counted = rows.select("y", "t").mapInArrow(count, "word string, toxic long, every long")
    table = counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("every").alias("every")).toArrow()
    lexicon = Lexicon.of(table)
    del table
    known = lexicon.known

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for found in sentence_words(b.column("t"), known):
                fixed = [b.column(c).slice(at, len(found)) for c in ("o", "y")]
                at += len(found)
                yield pa.RecordBatch.from_arrays([*fixed, *found.flatten()], names=["o", "y", "n", "sentence", "word"])

    order = dict(rows.dtypes)["o"]
    bagged = rows.mapInArrow(gather, f"o {order}, y double, n int, sentence array<int>, word array<int>").toArrow()
    bagged = bagged.sort_by([("o", "ascending"), ("y", "ascending"), ("n", "ascending")]).combine_chunks()
    flat = [bagged[c].combine_chunks().flatten().to_numpy() for c in ("sentence", "word")]
    lengths = pc.list_value_length(bagged["word"]).to_numpy()
    return lexicon.learn(bagged["y"].to_numpy(), bagged["n"].to_numpy(), lengths, *flat)


def fit_texts(texts: list[str] | pa.Array, labels: list[float]) -> ToxicityModel:
    """The model of ``fit`` for texts at hand."""
    y = np.array(labels, float)
    if len(set(y.tolist())) < 2:
        return _constant(len(y), y.sum())
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    counted = pa.Table.from_batches(word_counts(texts, y > 0.5)).group_by("word").aggregate([("toxic", "sum"), ("every", "sum")])
    lexicon = Lexicon.of(counted.rename_columns({"toxic_sum": "toxic", "every_sum": "every"}))
    found = pa.chunked_array(list(sentence_words(texts, lexicon.known))).combine_chunks()
    n, sentence, word = found.flatten()
    lengths = pc.list_value_length(word).to_numpy()
    return lexicon.learn(y, n.to_numpy(), lengths, sentence.flatten().to_numpy(), word.flatten().to_numpy())


def _constant(n: int, total: float) -> ToxicityModel:
    """Without any text, or with one label only: the rate of label 1, smoothed."""
    p = (total + 0.5) / (n + 1)
    return ToxicityModel({}, float(np.log(p / (1 - p))))


@dataclass(frozen=True)
class Lexicon:
    """The words of a sample that hold a feature that tells; ``feature`` and ``of_word``: their telling features."""

    known: dict[str, int]
    place: np.ndarray  # of a hash place among the telling ones, -1 for the others
    feature: np.ndarray
    of_word: np.ndarray

    @staticmethod
    def of(counts: pa.Table) -> Lexicon:
        counts = counts.sort_by("word")
        vocabulary = counts["word"].to_pylist()
        feature, sizes = array("i"), array("i")
        for w in vocabulary:
            hashed = _hashed(word_features(w))
            feature.extend(hashed)
            sizes.append(len(hashed))
        feature = np.frombuffer(feature, np.int32)
        of_word = np.repeat(np.arange(len(vocabulary), dtype=np.int32), np.frombuffer(sizes, np.int32))
        used = np.flatnonzero(_telling(counts["toxic"].to_numpy(), counts["every"].to_numpy(), feature, of_word))
        place = np.full(FEATURES, -1, np.int32)
        place[used] = np.arange(len(used))
        tells = place[feature] >= 0
        feature, of_word = place[feature[tells]], of_word[tells]
        matters = np.unique(of_word)
        known = {vocabulary[k]: i for i, k in enumerate(matters.tolist())}
        return Lexicon(known, place, feature, np.searchsorted(matters, of_word))

    def learn(
        self,
        y: np.ndarray,
        sentences: np.ndarray,
        lengths: np.ndarray,
        sentence: np.ndarray,
        word: np.ndarray,
        epochs: int = 400,
        rate: float = 0.3,
        decay: float = 1e-5,
    ) -> ToxicityModel:
        """Full-batch AdaGrad on the noisy-or likelihood.

        ``sentences``: how many each text has; ``lengths``: how many pairs of ``sentence`` and ``word`` are its own.
        """
        sentences = sentences.astype(np.int64)
        sent = sentence + np.repeat(np.cumsum(sentences) - sentences, lengths)
        doc = np.repeat(np.arange(len(y)), sentences)
        feature, of_word, n_words, n_used = self.feature, self.of_word, len(self.known), int(self.place.max()) + 1
        weights, bias = np.zeros(n_used), START_BIAS
        seen, seen_bias = np.full(n_used, 1e-8), 1e-8
        for _ in range(epochs):
            by_word = np.bincount(of_word, weights[feature], n_words)
            z = bias + np.bincount(sent, by_word[word], len(doc))
            q = 1 / (1 + np.exp(-z))
            safe = np.bincount(doc, -np.logaddexp(0, z), len(y))  # log of the chance that no sentence offends
            p = -np.expm1(safe)
            slope = np.where(y > 0.5, -np.exp(safe) / np.maximum(p, 1e-12), 1.0)
            g = q * slope[doc]
            grad = np.bincount(feature, np.bincount(word, g[sent], n_words)[of_word], n_used) / len(y)
            grad += decay * weights
            grad_bias = g.sum() / len(y)
            seen += grad * grad
            seen_bias += grad_bias * grad_bias
            weights -= rate * grad / np.sqrt(seen)
            bias -= rate * grad_bias / np.sqrt(seen_bias)
        names = sorted({f for w in self.known for f in word_features(w)})
        at = self.place[np.array(_hashed(names), np.int64)] if names else np.empty(0, np.int32)
        return ToxicityModel({f: float(weights[k]) for f, k in zip(names, at.tolist(), strict=True) if k >= 0}, float(bias))


def _telling(of_toxic: np.ndarray, of_all: np.ndarray, feature: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    """Which features are in toxic documents far more often than chance has it: by more standard deviations than the largest
    of so many features would be by chance. Counted are different words of documents; words that are seen once stay out."""
    good, every = np.zeros(FEATURES), np.zeros(FEATURES)
    for lo in range(0, len(feature), 1 << 20):
        f, w = feature[lo : lo + (1 << 20)], of_word[lo : lo + (1 << 20)]
        good += np.bincount(f, of_toxic[w], FEATURES)
        every += np.bincount(f, of_all[w], FEATURES)
    expected = every * (of_toxic.sum() / max(1, of_all.sum()))
    deviations = np.sqrt(2 * np.log(max(2, np.count_nonzero(every))))
    return good - expected > deviations * np.sqrt(np.maximum(expected, 1e-9))


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_docs: int = MAX_TRAIN_DOCS,
    max_chars: int = MAX_TRAIN_CHARS,
) -> DataFrame:
    """(text, label, _order) of at most ``max_docs`` labelled rows, drawn by the hash of the id.

    The draw is made on the narrow labels, so its ids are a bounded broadcast and no text is shuffled. An id labelled
    more than once has its largest label, one with several texts the least of them.
    """
    drawn = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_drawn"))
        .agg(F.max(label_col).alias("label"))
    )
    # Rows too late in this order to be drawn go before it is made, so that tasks send few; which are drawn does not change.
    share = min(1.0, (1.5 * max_docs + 100) / max(1, drawn.count()))
    order = F.pmod(F.xxhash64("_drawn"), F.lit(1_000_000))
    drawn = drawn.filter(order < int(share * 1_000_000) + 1).orderBy(order, "_drawn").limit(max_docs)
    texts = docs.filter(F.length(text_of(text_col)) <= max_chars).select(
        F.col(id_col).alias("_drawn"), text_of(text_col).alias("_text")
    )
    return (
        texts.join(F.broadcast(drawn), "_drawn")
        .groupBy("_drawn")
        .agg(F.min("_text").alias("text"), F.max("label").alias("label"))
        .select("text", "label", F.xxhash64("_drawn").alias("_order"))
    )


def _batch_maker(model: ToxicityModel) -> Callable[[], Callable[[pa.Array], list[pa.Array]]]:
    bias = model.bias

    def make():
        def weigh(token: str) -> tuple[float, bool]:
            return sum([model.word_score(w) for w in _WORD.findall(token.lower())]), ends_sentence(token)

        known = Memo(lambda fresh: [weigh(t) for t in fresh])

        def ranges(text: str, tokens: np.ndarray, p: np.ndarray) -> list[dict]:
            """Ranges of the sentences that offend; ``tokens``: sentence of each token, counted from 0."""
            places = [(0, 0)] * text[:1].isspace() + [m.span() for m in re.finditer(r"\S+", text)]
            places += [(len(text), len(text))] * text[-1:].isspace()  # the empty tokens at the ends
            cuts = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=len(p)))])
            if cuts[-1] != len(places):  # white space that only Arrow knows
                return [{"begin": 0, "end": len(text), "p": float(p.max())}]
            return [
                {"begin": places[cuts[k]][0], "end": places[cuts[k + 1] - 1][1], "p": float(p[k])}
                for k in np.flatnonzero(p >= 0.5)
            ]

        def one(texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
            different, token, at = words(texts)
            facts = known.of(different)
            score = np.array([f[0] for f in facts])[token]
            sentence, doc = sentence_numbers(np.array([f[1] for f in facts], bool)[token], at)
            told = np.flatnonzero(score)
            pairs = np.unique(sentence[told] << 32 | token[told])  # a token counts once in a sentence
            sums = np.bincount(pairs >> 32, np.array([f[0] for f in facts])[pairs & 0xFFFFFFFF], len(doc))
            z = np.clip(bias + sums, -500, 500)
            safe = np.bincount(doc, -np.logaddexp(0, z), len(texts))  # log of the chance that no sentence offends
            p = 1 / (1 + np.exp(-z))
            offending: list[list[dict]] = [[] for _ in range(len(texts))]
            begins = np.searchsorted(doc, np.arange(len(texts) + 1))
            for d in np.unique(doc[p >= 0.5]).tolist():
                own = sentence[at[d] : at[d + 1]] - begins[d]
                offending[d] = ranges(texts[d].as_py(), own, p[begins[d] : begins[d + 1]])
            return -np.expm1(safe), offending

        def batch(texts: pa.Array) -> list[pa.Array]:
            got = [one(part) for part in slices(texts)]
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            scores = np.concatenate([np.zeros(0), *[g[0] for g in got]])
            return [pa.array(np.clip(scores, 0.0, 1.0)), pa.array([x for g in got for x in g[1]], kind)]

        return batch

    return make


SCHEMA = "score double, offending array<struct<begin:int,end:int,p:double>>"


def scorer(model: ToxicityModel) -> Callable[[Column], Column]:
    """Column function: struct of ``score`` (0 to 1) and ``offending``, the sentences with p >= 0.5 as code
    point ranges of the text.

    Whole texts are read, and tokens are cut at white space. NULL, empty and blank texts are one empty token.
    """
    return per_text(_batch_maker(model), SCHEMA)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns as they are; NULL texts are scored as empty."""
    return docs.filter(scorer(model)(F.col(text_col)).getField("score") < threshold)
