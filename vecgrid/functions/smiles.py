"""Lexical reading of SMILES strings with built-in column functions.

No chemistry model is involved: "aromatic" means written in lower case, rings
are ring-closure labels / 2. Descriptors that need chemistry (mass, clogP,
sp3 fraction) come from a user encoder.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecgrid.functions.columns import let

# The lexical units of a SMILES string.
TOKEN = r"\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnops]|%[0-9][0-9]|[0-9]|[-=#$:/\\.()]"
ATOM = r"^(\[.*|Br|Cl|[BCNOPSFIbcnops])$"
HYDROGEN = r"^\[[0-9]*H[0-9]*[-+]*\]$"
AROMATIC = r"^([bcnops]|\[[0-9]*(se|as|[bcnops]).*)$"
RING_LABEL = r"^(%[0-9][0-9]|[0-9])$"


def as_column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def core(col: str | Column) -> Column:
    """Text before the first space (the rest is an extension or a name)."""
    return F.substring_index(as_column(col), " ", 1)


def tokens(col: str | Column) -> Column:
    return F.regexp_extract_all(core(col), F.lit(TOKEN), F.lit(0))


def _depths_fine(toks: Column) -> Column:
    """Parentheses close after they open and all are closed."""
    moves = F.transform(toks, lambda t: F.when(t == "(", 1).when(t == ")", -1).otherwise(0))
    end = F.aggregate(
        moves,
        F.lit(0),
        lambda depth, m: F.when((depth < 0) | (depth + m < 0), F.lit(-1)).otherwise(depth + m),
    )
    return end == 0


def _rings_paired(labels: Column) -> Column:
    """Every label occurs an even number of times: sorted, they come in equal pairs."""
    return let(
        F.array_sort(labels),
        lambda x: (F.size(x) % 2 == 0)
        & ((F.size(x) < 2) | F.forall(F.sequence(F.lit(1), F.size(x), F.lit(2)), lambda i: F.get(x, i - 1) == F.get(x, i))),
    )


def _labels(toks: Column) -> Column:
    return F.filter(toks, lambda t: t.rlike(RING_LABEL))


def _lexical(text: Column, toks: Column) -> Column:
    covers = (text != "") & (F.array_join(toks, "") == text)
    return F.coalesce(
        F.when(covers, _rings_paired(_labels(toks)) & _depths_fine(toks)).otherwise(F.lit(False)), F.lit(False)
    )


def is_lexical(col: str | Column) -> Column:
    """True iff the whole string splits into known units, ring labels pair up
    and parentheses balance. False for NULL and empty strings."""
    return let(tokens(col), lambda toks: _lexical(core(col), toks))


def lexical_tokens(col: str | Column) -> Column:
    """The units of a lexically valid string, NULL for any other."""
    return let(tokens(col), lambda toks: F.when(_lexical(core(col), toks), toks))


def string_descriptors(col: str | Column) -> Column:
    """Struct of hac, num_aromatic_atoms, fraction_aromatic_atoms, number_of_rings.

    All fields are NULL for a string that is not lexically valid. Counts are "as
    written": an aromatic ring in Kekule form has no aromatic atoms here.
    """
    return let(lexical_tokens(col), _describe)


def _describe(toks: Column) -> Column:
    ok = toks.isNotNull()
    hac = F.size(F.filter(toks, lambda t: t.rlike(ATOM) & ~t.rlike(HYDROGEN)))
    aromatic = F.size(F.filter(toks, lambda t: t.rlike(AROMATIC)))
    rings = (F.size(_labels(toks)) / 2).cast("int")
    fraction = F.when(hac > 0, aromatic / hac).otherwise(F.lit(0.0))
    return F.struct(
        F.when(ok, hac).alias("hac"),
        F.when(ok, aromatic).alias("num_aromatic_atoms"),
        F.when(ok, fraction).alias("fraction_aromatic_atoms"),
        F.when(ok, rings).alias("number_of_rings"),
    )
