import numpy as np
import pytest

from vecgrid.functions import features as X
from vecgrid.functions.columns import to_vector, widen
from vecgrid.functions.smiles import string_descriptors
from vecgrid.operators.quality import split_valid

MIXED = [
    ("CCNC(=O)Nc1cn2c(-c3ncc(C)cn3)cc(-c3cncnc3)cc2n1", (28, 21, 4)),
    ("invalid_smiles", None),
    (
        "COC(=O)[C@@H]1[C@@H]2C(=O)N(CC(=O)NC[C@H]3O[C@@H](n4ccc(=O)[nH]c4=O)[C@H](O)[C@@H]3O)"
        "C(=O)[C@@H]2N[C@@H]1c1ccccc1",
        (40, 12, 5),
    ),
    ("", None),
    ("C1CC1", (3, 0, 1)),
    ("C#Cc1ccc(-c2ccccc2)cc1", (14, 12, 2)),
    ("C1=CC=CC=C1C", (7, 0, 1)),
    ("C1=CC=CC=C", None),
    (None, None),
    ("CC)C(", None),
    ("[H]O[H] |extension|", (1, 0, 0)),
]


def test_descriptors_of_mixed_strings(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(MIXED)], "i int, smiles string")
    rows = df.withColumn("d", string_descriptors("smiles")).orderBy("i").collect()
    for row, (text, want) in zip(rows, MIXED, strict=True):
        got = (row.d.hac, row.d.num_aromatic_atoms, row.d.number_of_rings)
        assert got == (want or (None, None, None)), text
        if want:
            assert abs(row.d.fraction_aromatic_atoms - want[1] / want[0]) < 1e-12


def test_chain_and_empty_inputs(spark):
    df = spark.createDataFrame([("C" * i,) for i in range(1, 100)], "smiles string")
    got = df.select("smiles", string_descriptors("smiles").alias("d")).collect()
    assert all(r.d.hac == len(r.smiles) for r in got) and len(got) == 99
    none = df.filter("false")
    for kind in ("mhfp", "mqn", "mapc", "morgan"):
        assert X.featurize(none, kind=kind).count() == 0


def test_split_valid_keeps_every_row(spark):
    df = spark.createDataFrame([(s,) for s, _ in MIXED], "smiles string")
    good, bad = split_valid(df, "smiles")
    assert (good.count(), bad.count()) == (6, 5)
    assert {r.error for r in bad.collect()} == {"missing", "empty", "not lexically valid"}


@pytest.mark.parametrize("kind,width", [("mhfp", 512), ("MQN", 27), ("mapc", 1024), ("morgan", 1024)])
def test_dispatch_widths_with_bad_row_and_single_row(spark, kind, width):
    df = spark.createDataFrame([("C1CCCCC1",), (None,)], "smiles string")
    opts = {}
    got = X.featurize(df, kind=kind, descriptors=True, **opts).collect()
    assert [len(r.fp) if r.fp is not None else None for r in got] == [width, None]
    assert got[0].hac == 6
    with pytest.raises(ValueError):
        X.featurize(df, kind="map4")


def shingles(text, n):
    words = text.split()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or {" ".join(words)}


def test_minhash_definition_and_jaccard(spark):
    texts = ["a b c d e f g h", "a b c d e f g x", "q r", "   ", None, "a b c d e f g h"] + [
        " ".join(f"w{i * j % 97}" for j in range(400)) for i in range(1, 30)
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    sig = [r.s for r in X.minhash(df, "t", "s", 256, tokenizer="words").orderBy("i").collect()]
    a, b = X.permutation_params(256)
    for text, got in zip(texts, sig, strict=True):
        if text is None or not text.strip():
            assert got is None
            continue
        h = np.array([X._hash32_py(s) % X.PRIME for s in shingles(text, 3)], dtype=object)
        want = [min((int(x) * int(p) + int(q)) % X.PRIME for x in h) for p, q in zip(a, b, strict=True)]
        assert list(got) == want
    assert sig[0] == sig[5]
    assert abs(np.mean(np.array(sig[0]) == np.array(sig[1])) - 5 / 7) < 0.12


def test_hashed_bits_definition(spark):
    df = spark.createDataFrame([("a b c a b",), ("x",), ("",), (None,)], "t string")
    rows = X.dense_bits(df.select(X.hashed_bits("t", 64, 2, "words").alias("s")), "s", 64, "d").collect()
    runs = ["a", "b", "c", "a b", "b c", "c a", "a b c", "b c a", "c a b"]
    want = sorted({X._hash32_py(r) % 64 for r in runs})
    assert list(rows[0].s) == want
    assert [i for i, bit in enumerate(rows[0].d) if bit] == want and len(rows[0].d) == 64
    assert list(rows[1].s) == [X._hash32_py("x") % 64]
    assert rows[2].s is None and rows[3].d is None


def test_count_profile(spark):
    df = spark.createDataFrame([("CC(=O)Cl",), ("[NH4+].[Cl-]",)], "t string")
    names = list(X.SMILES_PATTERNS)
    got = [dict(zip(names, r.c, strict=True)) for r in X.count_profile(df, "t", "c").collect()]
    assert (got[0]["C"] - got[0]["Cl"], got[0]["Cl"], got[0]["double_bond"], got[0]["O"]) == (2, 1, 1, 1)
    assert (got[1]["positive_charge"], got[1]["negative_charge"], got[1]["dot"]) == (1, 1, 1)


def test_encode_with_isolates_bad_rows(spark):
    def make():
        def enc(s):
            if s == "bad":
                raise RuntimeError("cannot read")
            return [len(s), s.count("C")] if s != "short" else [1]

        return enc

    df = spark.createDataFrame([("CCO",), ("bad",), ("short",), (None,), ("N",)], "smiles string")
    out = X.encode_with(df, "smiles", make, 2)
    rows = {r.smiles: (r.fp, r.error) for r in out.collect()}
    assert rows["CCO"] == ([3.0, 2.0], None) and rows["N"] == ([1.0, 0.0], None)
    assert rows["bad"][0] is None and "cannot read" in rows["bad"][1]
    assert "expected 2" in rows["short"][1] and rows[None][0] is None
    good, bad = split_valid(out)
    assert (good.count(), bad.count()) == (2, 3)


def test_widen_and_back(spark):
    df = spark.createDataFrame([("s", [1.0, 2.0, 3.0])], "smiles string, fp array<double>")
    wide = widen(df, "fp", 3)
    assert wide.columns == ["smiles", "fp_1", "fp_2", "fp_3"]
    assert to_vector(wide, ["fp_1", "fp_2", "fp_3"]).first() == df.first()
    assert widen(df, "fp", 4).first().fp_4 is None
