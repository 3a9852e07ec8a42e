"""Neighbour maps: node table and edge table of one cell or of the representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgrid.functions import features
from vecgrid.functions.smiles import string_descriptors
from vecgrid.operators.forest import spanning_forest
from vecgrid.operators.neighbours import knn_coords, knn_minhash
from vecgrid.operators.ranking import ranked
from vecgrid.operators.skew import lookup_join
from vecgrid.session import stable

# The property columns of a map, in display order.
PROPERTIES = ("hac", "frac_aromatic", "num_rings", "clogp", "frac_csp3", "MW")
UNKNOWN = "Unknown"


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(UNKNOWN))


def _escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def node_label(col: str, cat_cols: Sequence[str] = (), link: bool = False) -> Column:
    """The string itself, then its categories joined by ``__``, as a link if wanted."""
    if not cat_cols:
        return F.col(col)
    label = F.concat_ws("__", *[_text(c) for c in cat_cols])
    if link:
        safe = _escaped(label)
        label = F.concat(F.lit('<a href="/generate/'), safe, F.lit('" target="_blank">'), safe, F.lit("</a>"))
    return F.concat_ws("__", F.col(col), label)


def node_labels(df: DataFrame, col: str, cat_cols: Sequence[str] = (), link: bool = False, out: str = "label") -> DataFrame:
    return df.withColumn(out, node_label(col, cat_cols, link))


def category_legend(df: DataFrame, col: str) -> DataFrame:
    """(value, code): codes 0, 1, ... in value order; missing counts as ``Unknown``."""
    values = df.select(_text(col).alias("value")).distinct()
    return ranked(values, ["value"], out="_r").select("value", (F.col("_r") - 1).cast("bigint").alias("code"))


def category_codes(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Add the code of each row's category."""
    out = out or f"{col}_code"
    legend = stable(category_legend(df, col).select(F.col("value").alias("_cat"), F.col("code").alias(out)))
    return lookup_join(df.withColumn("_cat", _text(col)), legend, ["_cat"]).drop("_cat")


def property_columns(df: DataFrame, col: str = "smiles") -> DataFrame:
    """Add the six map properties. The last three need a chemistry model: columns
    named so, or as in a descriptor table, are taken over, otherwise they are NULL."""
    given = {"clogp": ("clogp", "clogP"), "frac_csp3": ("frac_csp3", "fraction_Csp3"), "MW": ("MW", "molecular_weight")}
    have = set(df.columns)

    def taken(name: str) -> Column:
        source = next((c for c in given[name] if c in have), None)
        return (F.col(source) if source else F.lit(None)).cast("double").alias(name)

    rest = [c for c in df.columns if c not in PROPERTIES]
    return df.withColumn("_d", string_descriptors(col)).select(
        *rest,
        F.col("_d.hac").alias("hac"),
        F.col("_d.fraction_aromatic_atoms").alias("frac_aromatic"),
        F.col("_d.number_of_rings").alias("num_rings"),
        *[taken(c) for c in ("clogp", "frac_csp3", "MW")],
    )


def build_map(
    df: DataFrame,
    id_col: str,
    col: str,
    coords: Sequence[str] | None = None,
    k: int = 20,
    permutations: int = 512,
    trees: int | None = None,
    cat_cols: Sequence[str] = (),
    link: bool = False,
    kind: str = "mhfp",
    kc: int = 10,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a map: the spanning forest of the neighbour graph.

    Neighbours come from signatures of ``col`` (see ``map_edges``), or from ``coords`` if given.
    """
    return map_nodes(df, col, cat_cols, link), map_edges(df, id_col, col, coords, k, permutations, trees, kind, kc, **options)


def map_nodes(df: DataFrame, col: str, cat_cols: Sequence[str] = (), link: bool = False) -> DataFrame:
    """Node table of a map: label, the six properties, a code for each category."""
    nodes = property_columns(node_labels(df, col, cat_cols, link), col)
    for c in cat_cols:
        nodes = category_codes(nodes, c)
    return nodes


def map_edges(
    df: DataFrame,
    id_col: str,
    col: str,
    coords: Sequence[str] | None = None,
    k: int = 20,
    permutations: int = 512,
    trees: int | None = None,
    kind: str = "mhfp",
    kc: int = 10,
    **options,
) -> DataFrame:
    """Edge table of a map.

    ``kind`` names the feature whose equal positions measure closeness: ``mhfp`` (default), ``mapc`` or a registered one that
    gives ``permutations`` whole numbers. Strings are cut into SMILES units unless ``tokenizer`` says otherwise.
    """
    if coords:
        return spanning_forest(knn_coords(df, id_col, coords, k))
    slim = df.select(*dict.fromkeys([id_col, col]))
    if kind.lower() == "mhfp":
        signed = features.featurize(slim, col, kind, "_sig", permutations=permutations, **options)
    elif kind.lower() == "mapc":
        signed = features.featurize(slim, col, kind, "_sig", fp_size=permutations, **options)
    else:
        signed = features.featurize(slim, col, kind, "_sig", **options)
    return spanning_forest(knn_minhash(signed, id_col, "_sig", permutations, k, trees, kc))
