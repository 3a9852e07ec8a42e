import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecgrid.llm import langid as L
from vecgrid.llm import piece_codec as C
from vecgrid.llm import queries as Q
from vecgrid.llm import token_count as K
from vecgrid.llm import toxicity as T

from .helpers import ODD_TEXTS, no_docs, odd_docs

SF = "/root/testdata/sf0.01"


# toxicity


@pytest.fixture(scope="module")
def offended():
    clean = ["We went home early. The soup was good and hot.", "Nothing to see here, move on. Thanks for all.", "Rain fell on the roof."]
    bad = ["The soup was good and hot. You are a moron and a clown.", "Rain fell. What a moron you are! Thanks for all."]
    return T.fit_texts(clean * 60 + bad * 12, [0.0] * 180 + [1.0] * 24)


def test_op1_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = Q.QUERIES["op1_toxicity"](spark, SF).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    tested = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in tested) >= 0.95 * len(tested)


def test_offending_sentences_are_found(spark, offended):
    text = "It was a fine day, all said. You are such a moron, you clown! Thanks for all."
    df = spark.createDataFrame([(text,), ("Rain fell on the roof.",)], "text string")
    rows = df.select(T.scorer(offended)("text").alias("r"), "text").select("r.*", "text").collect()
    assert rows[0].score > 0.5 > rows[1].score and not rows[1].offending
    assert [text[s.begin : s.end] for s in rows[0].offending] == ["You are such a moron, you clown!"]


def test_noisy_or_against_brute_force(offended):
    text = " A moron. Then nothing at all \n\n" + "clown " * 90 + "! end"
    got = T._batch_maker(offended)()(pa.array([text, None, "", " "]))[0].to_pylist()

    def one(text):
        sentences, own = [], []
        for token in ([""] if not text.strip() else []) or text.split():
            own.append(token)
            if T.ends_sentence(token) or len(own) == T.SENTENCE_WORDS:
                sentences.append(own)
                own = []
        sentences += [own] if own else []
        keep = 1.0
        for s in sentences:
            z = offended.bias
            for token in set(s):
                z += sum(offended.word_score(w) for w in T._WORD.findall(token.lower()))
            keep *= 1 - 1 / (1 + np.exp(-z))
        return 1 - keep

    # the space in front is an empty token of the first sentence
    assert np.allclose(got, [one(text), one(""), one(""), one("")], atol=1e-6)


def test_toxicity_odd_rows(spark, offended):
    kept = T.keep_clean(odd_docs(spark), offended)
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(ODD_TEXTS)
    assert T.keep_clean(no_docs(spark), offended).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (5, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    sample = T.training_sample(odd_docs(spark), labels)
    assert {(r.text, r.label) for r in sample.collect()} == {(ODD_TEXTS[0][1], 1), ("", 0)} and sample.count() == 3
    assert T.training_sample(odd_docs(spark), labels, max_docs=2).count() == 2
    constant = T.fit(sample.filter("label = 1"))
    assert 0.5 < 1 / (1 + np.exp(-constant.bias)) < 1 and not constant.weights
    assert T.fit(sample.limit(0)).bias == 0.0


# language


def slow_counts(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = {}
    for w in words:
        for n in (1, 2, 3):
            padded = f" {w} "
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != " " and not (n == 3 and g[1] == " "):
                    out[g] = out.get(g, 0) + 1
    return out


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


@pytest.mark.parametrize("block", [1 << 20, 5, 1])
def test_ngrams_against_brute_force(monkeypatch, block):
    monkeypatch.setattr(L, "_BLOCK", block)
    for text in ["", None, "12 !", "a", "Das ist ein Haus, das ist ein.", " ab  ab\nc-d ", "日本語 é😀x"]:
        codes, counts = L.ngram_counts(text)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in slow_counts(text).items()}


def test_op2_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.QUERIES["op2_language_id"](spark, SF).collect()
    assert len(got) == len(langs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    tested = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out]
    assert sum(tested) >= 0.97 * len(tested)


def test_profiles_against_brute_force(spark):
    texts = [("x", "abc abd"), ("x", "abc"), ("y", "zz yy"), (None, "q"), ("y", None), ("z", "1")]
    got = L.fit_profiles(spark.createDataFrame(texts, "lang string, text string").repartition(3), k=5)
    assert sorted(got) == ["x", "y"]
    for lang, own in (("x", ["abc abd", "abc"]), ("y", ["zz yy"])):
        total = {}
        for t in own:
            for g, n in slow_counts(t).items():
                total[code(g)] = total.get(code(g), 0) + n
        assert got[lang].tolist() == sorted(total, key=lambda c: (-total[c], c))[:5]
    # out-of-place distance of a document
    one = L.identify(got, 5)
    own = L.ranking(*L.ngram_counts("abc"), 5).tolist()
    distance = sum(abs(got["x"].tolist().index(c) - i) if c in got["x"].tolist() else 5 for i, c in enumerate(own))
    assert one("abc") == ("x", 1 - distance / (5 * len(own)))
    assert one("") == one(None) == one("1 2") == ("und", 0.0) and L.identify({})("abc") == ("und", 0.0)


def test_language_odd_rows(spark):
    profiles = L.fit_profiles(odd_docs(spark))
    kept = L.keep_languages(odd_docs(spark), profiles)
    assert kept.columns == odd_docs(spark).columns
    # NULL, empty, blank and letterless texts are in no language
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 5, 6, 8, 9]
    assert L.keep_languages(odd_docs(spark), profiles, {"fr"}).count() == 0
    assert L.fit_profiles(no_docs(spark)) == {} and L.keep_languages(no_docs(spark), {}).count() == 0


# token counts


def test_automaton_against_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = random.Random(1)
    letters = "abcd"
    for trial in range(20):
        pieces = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(25)}
        pieces |= {"##" + "".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(25)}
        vocab = {"[UNK]": 0} | {p: i + 1 for i, p in enumerate(sorted(pieces))}
        library = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=100))
        library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        automaton = K.Automaton(K.Vocabulary.of(pieces))
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(300)]
        got = [automaton.count(w) for w in words]
        want = [e.tokens for e in library.encode_batch(words)]
        assert got == [0 if t == ["[UNK]"] else len(t) for t in want]


def test_op5_against_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = K.Vocabulary.of_piece_model(Q.tokenizer_file("piece_bpe_32k.model"))
    vocab = {"[UNK]": 0}
    for p in [*sorted(v.initial), *("##" + c for c in sorted(v.continuing))]:
        vocab.setdefault(p, len(vocab))
    library = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=100))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    encoded = library.encode_batch([r.text or "" for r in docs])
    want = {r.doc_id: (len(e.ids), e.ids.count(0)) for r, e in zip(docs, encoded, strict=True)}
    got = Q.QUERIES["op5_token_counts"](spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.n_unknown) for r in got} == want and len(got) == len(docs)


def test_counts_odd_rows(spark):
    make = lambda: K.Vocabulary.of(["the", "qu", "##ick", "word", "n", "##o"])
    got = K.count_tokens(odd_docs(spark), make).collect()
    by_text = {t: tuple(r[1:]) for (_, t), r in zip(ODD_TEXTS, got, strict=True)}
    assert by_text[None] == by_text[""] == by_text["   \n\t "] == (0, 0, 0)
    assert by_text["no"] == (1, 2, 0) and by_text[ODD_TEXTS[5][1]] == (60_001, 60_001, 1)
    assert K.count_tokens(no_docs(spark), make).count() == 0


# sentencepiece


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    path = Q.tokenizer_file("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_codec_against_the_library(model):
    path, library = model
    rng = random.Random(1)
    alphabet = "ab the ing▁ \t\n\0é日本ａ́😀<s></s><unk><0x0A>"
    texts = ["", " ", "  ", "   a", "a   ", "▁", "▁▁a", " ▁ a", "\n▁a", "a\n\nb", "\r\n a", "x" * 3000, "ab " * 3000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    codec = C.PieceCodec(path)
    ids, decoded = zip(*codec.encode_batch(pa.array(texts)), strict=True)
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want
    assert list(decoded) == library.decode(want) and codec.mismatches == 0
    words = ["▁hello", "▁antidisestablishment", "▁日本", "▁" + "ab" * 40]
    assert [codec.merge(w) for w in words] == [library.encode(w[1:]) for w in words]


def test_memo_generations(model):
    path, library = model
    codec = C.PieceCodec(path, memo=5)
    texts = ["one two three four five six seven", "seven eight one two", "one  two\nten", "six six"]
    for _ in range(3):
        ids, _ = zip(*codec.encode_batch(pa.array(texts)), strict=True)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == library.encode(texts, add_bos=True, add_eos=True)


def test_op6_against_the_library(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        ids = model[1].encode(r.text or "", add_bos=True, add_eos=True)
        text = model[1].decode(ids)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = Q.QUERIES["op6_piece_codec"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(docs)


def test_codec_odd_rows(spark, model):
    rows = odd_docs(spark).select("doc_id", "text", C.codec(model[0])(F.col("text")).alias("r")).collect()
    for r in rows:
        ids = np.frombuffer(r.r.ids, "<u4").tolist()
        assert ids == model[1].encode(r.text or "", add_bos=True, add_eos=True) and r.r.n_tokens == len(ids)
        assert r.r.decoded == model[1].decode(ids) and r.r.mismatches == 0
    assert no_docs(spark).select(C.codec(model[0])(F.col("text")).alias("r")).count() == 0


def test_op5_counts_long_words(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = K.Vocabulary.of_piece_model(Q.tokenizer_file("piece_bpe_32k.model"))
    vocab = {"[UNK]": 0}
    for p in [*sorted(v.initial), *("##" + c for c in sorted(v.continuing))]:
        vocab.setdefault(p, len(vocab))
    library = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=1_000_000))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    texts = ["a" * 99, "a" * 100, "a" * 101, "see " + "https/example/" * 40 + " here " + "no" * 900, "the", "a" * 101 + "\x01" + " end", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    encoded = library.encode_batch([t or "" for t in texts])
    got = {r.doc_id: (r.n_tokens, r.n_unknown) for r in Q.QUERIES["op5_token_counts"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(e.ids), e.ids.count(0)) for k, e in enumerate(encoded)} and got[3][0] > 200


def test_toxicity_fit_in_tasks(spark):
    make = lambda rows: spark.createDataFrame(rows, "text string, label int, _order bigint")
    assert T.fit(make([])) == T.ToxicityModel({}, 0.0)
    assert T.fit(make([("a", 1, 1), (None, 1, 2), ("x", None, 3)])).weights == {}
    assert T.fit(make([("", 0, 1), (None, 1, 2), ("ok fine.", 0, 2)])).weights == {}
    rows = [("this is fine text. really", 0, k) for k in range(180)] + [("you vile scum. ok", 1, 200 + k) for k in range(24)]
    assert T.fit(make(rows)) == T.fit_texts([r[0] for r in rows], [float(r[1]) for r in rows])
