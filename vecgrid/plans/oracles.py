"""The same results as plain SQL over the same tables, to check ``queries`` against.

Queries missing here have no SQL form: sketches and PCA coordinates (compared with
numpy in the tests) and spanning forests (compared with Kruskal's algorithm).
"""

from __future__ import annotations

from vecgrid.functions import features as X
from vecgrid.functions import smiles
from vecgrid.plans.queries import NEIGHBOURS, PERMUTATIONS, WIDTH

WORD = X.WORD
PRIME = X.PRIME


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def probs(n: int) -> str:
    return "[" + ", ".join(repr(i / n) for i in range(n + 1)) + "]::DOUBLE[]"


def binned(x: str, edges: str, n: int) -> str:
    x = f"coalesce({x}, 'nan'::DOUBLE)"
    return f"least(greatest(len(list_filter({edges}, lambda y: y <= {x})) - 1, 0), {n - 1})::BIGINT"


def smiles_sql(key: str) -> str:
    atoms = f"translate({key}::VARCHAR, '0123456789', 'CNOcnoSPFI')"
    return (
        f"CASE WHEN {key} % 7 = 0 THEN 'C1' || {atoms} WHEN {key} % 3 = 0 THEN '[nH]1C' || {atoms} || 'C1 name' "
        f"WHEN {key} % 3 = 1 THEN 'Cl' || {atoms} || '(=O)C' ELSE {atoms} END"
    )


def described(source: str, keep: str) -> str:
    """CTEs ending in ``d``: keep, text, ok, hac, aromatic, labels of every string of ``source``."""
    return f"""
src AS ({source}),
tok AS (SELECT *, split_part(smiles, ' ', 1) AS core, regexp_extract_all(split_part(smiles, ' ', 1), {quoted(smiles.TOKEN)}) AS t FROM src),
lab AS (SELECT *, list_filter(t, lambda a: regexp_matches(a, {quoted(smiles.RING_LABEL)})) AS labels FROM tok),
d AS (SELECT {keep}, smiles, t, labels,
  (core <> '' AND array_to_string(t, '') = core
   AND len(list_filter(list_distinct(labels), lambda x: len(list_filter(labels, lambda y: y = x)) % 2 = 1)) = 0
   AND list_reduce(list_transform(t, lambda a: CASE a WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END),
       lambda s, m: CASE WHEN s < 0 OR s + m < 0 THEN -1 ELSE s + m END, 0) = 0) AS ok,
  len(list_filter(t, lambda a: regexp_matches(a, {quoted(smiles.ATOM)}) AND NOT regexp_matches(a, {quoted(smiles.HYDROGEN)})))::BIGINT AS n_heavy,
  len(list_filter(t, lambda a: regexp_matches(a, {quoted(smiles.AROMATIC)})))::BIGINT AS n_aromatic
  FROM lab)"""


PARTS = f"SELECT p_partkey, {smiles_sql('p_partkey')} AS smiles FROM part"
PART_UNITS = f"WITH {described(PARTS, 'p_partkey')} SELECT p_partkey AS doc_id, t FROM d WHERE ok"
FRACTION = "round(CASE WHEN ok THEN CASE WHEN n_heavy > 0 THEN n_aromatic / n_heavy ELSE 0.0 END END, 4)"


def counts_sql(column: str, patterns: dict[str, str]) -> str:
    return " || ',' || ".join(f"len(regexp_extract_all({column}, {quoted(p)}))" for p in patterns.values())


def runs(n: int) -> str:
    """All runs of n neighbouring words of the list ``t``."""
    if n == 1:
        return "t"
    shifted = ", ".join(f"t[{i + 1}:len(t) - {n - 1 - i}]" for i in range(n))
    joined = " || ' ' || ".join(f"z[{i + 1}]" for i in range(n))
    return f"list_transform(list_zip({shifted}), lambda z: {joined})"


DOC_WORDS = f"SELECT doc_id, regexp_extract_all(text, {quoted(WORD)}) AS t FROM documents"


def words(n: int, source: str = DOC_WORDS) -> str:
    """CTEs: ``w`` words per document, ``g`` its word runs of length n (or the whole, if shorter)."""
    return f"""
w AS ({source}),
g AS (SELECT doc_id, unnest(CASE WHEN len(t) >= {n} THEN {runs(n)} ELSE [array_to_string(t, ' ')] END) AS s FROM w WHERE len(t) > 0),
h AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT % {PRIME} AS h FROM g)"""


def signatures(permutations: int, shingle: int, source: str = DOC_WORDS) -> str:
    return f"""{words(shingle, source)},
p AS (SELECT i, 1 + ('0x' || substr(md5('a:42:' || i), 1, 8))::BIGINT % {PRIME - 1} AS a,
      ('0x' || substr(md5('b:42:' || i), 1, 8))::BIGINT % {PRIME} AS b FROM range({permutations}) r(i)),
m AS (SELECT doc_id, i, min((a * h + b) % {PRIME}) AS v FROM h, p GROUP BY doc_id, i),
sig AS (SELECT doc_id, list(v ORDER BY i) AS s FROM m GROUP BY doc_id)"""


def bits_of(source: str) -> str:
    return f"""
w AS ({source}),
g AS ({' UNION ALL '.join(f"SELECT doc_id, unnest({runs(n)}) AS s FROM w WHERE len(t) >= {n}" for n in (1, 2, 3))}),
bits AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT % 1024 AS bit FROM g)"""


BITS = bits_of(DOC_WORDS)

CELLS = f"""
e1 AS (SELECT quantile_cont(l_extendedprice, {probs(5)}) AS e FROM lineitem),
b1 AS (SELECT lineitem.*, {binned('l_extendedprice', 'e', 5)} AS c1 FROM lineitem, e1),
e2 AS (SELECT c1, quantile_cont(l_quantity, {probs(5)}) AS e FROM b1 GROUP BY c1),
b2 AS (SELECT b1.*, {binned('l_quantity', 'e', 5)} AS c2 FROM b1 JOIN e2 USING (c1)),
e3 AS (SELECT c1, c2, quantile_cont(l_discount, {probs(5)}) AS e FROM b2 GROUP BY c1, c2),
b3 AS (SELECT b2.*, {binned('l_discount', 'e', 5)} AS c3 FROM b2 JOIN e3 USING (c1, c2))"""

COVARIANCE = f"""
v AS (SELECT vec_id, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM embeddings, range(1, {WIDTH + 1}) r(i))"""

NORMS = f"""WITH {COVARIANCE}, c AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY dim) AS x FROM v)
SELECT vec_id, round(sum(x * x), 5) AS norm2 FROM c GROUP BY vec_id"""

COVARIANCES = f"""WITH {COVARIANCE}
SELECT a.dim::BIGINT AS dim, b.dim::BIGINT AS other, round(covar_pop(a.x, b.x), 6) + 0.0 AS cov
FROM v a JOIN v b USING (vec_id) GROUP BY a.dim, b.dim"""

CHUNKS = "(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 500"
SQUARE = "o_totalprice * o_totalprice"


def knn_sql(source: str = DOC_WORDS) -> str:
    """Neighbours by signatures among all pairs."""
    return f"""WITH {signatures(PERMUTATIONS, 3, source)},
        scored AS (SELECT a.doc_id AS src, b.doc_id AS dst, count(*)::BIGINT AS matches
              FROM m a JOIN m b ON a.i = b.i AND a.v = b.v AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id)
        SELECT src, dst, matches, round(1 - matches / {PERMUTATIONS}, 6) AS weight,
        row_number() OVER (PARTITION BY src ORDER BY matches DESC, dst) AS rank FROM scored QUALIFY rank <= {NEIGHBOURS}"""


NEAR_COPIES = f"""SELECT doc_id, regexp_extract_all(text, {quoted(WORD)}) AS t FROM (
    SELECT doc_id, text FROM documents UNION ALL
    SELECT doc_id + 1000000000, concat_ws(' ', (SELECT arg_min(text, doc_id) FROM documents), {", ".join(f"'x{n}y' || doc_id" for n in range(6))})
    FROM documents WHERE doc_id % 2 = 0)"""


def coords_sql(*coords: str) -> str:
    """The five nearest other customers among all pairs, weights unrounded."""
    a, b = ([c.replace("c_", f"{t}.c_") + "::DOUBLE" for c in coords] for t in "ab")
    d2 = " + ".join(f"({p} - {q}) * ({p} - {q})" for p, q in zip(a, b, strict=True))
    return f"""SELECT src, dst, sqrt(d2) AS weight, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank
        FROM (SELECT a.c_custkey AS src, b.c_custkey AS dst, {d2} AS d2 FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey)
        QUALIFY rank <= 5"""


VECTOR_KNN = """SELECT src, dst, round(weight, 4) AS weight, row_number() OVER (PARTITION BY src ORDER BY weight, dst) AS rank
    FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS weight
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) QUALIFY rank <= 5"""


def docs_graph() -> str:
    return knn_sql().replace(f"round(1 - matches / {PERMUTATIONS}, 6)", f"1 - matches / {PERMUTATIONS}")


def forest_sql(graph: str) -> str:
    """Kruskal: edges in order of (weight, src, dst), one step of the recursion each; the state is the list of component labels."""
    return f"""WITH RECURSIVE knn AS ({graph}),
        e AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, min(weight) AS w FROM knn GROUP BY 1, 2),
        n AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM (SELECT u AS x FROM e UNION SELECT v FROM e)),
        r AS (SELECT row_number() OVER (ORDER BY w, u, v) AS i, u, v, w, a.k AS ku, b.k AS kv FROM e JOIN n a ON a.x = u JOIN n b ON b.x = v),
        ends AS (SELECT list(ku ORDER BY i) AS us, list(kv ORDER BY i) AS vs, (SELECT count(*) FROM n) AS size FROM r),
        step AS (SELECT 0::BIGINT AS i, range(1, size + 1) AS labels, false AS taken FROM ends UNION ALL
              SELECT i + 1, CASE WHEN labels[us[i + 1]] = labels[vs[i + 1]] THEN labels ELSE
                list_transform(labels, lambda x: CASE WHEN x = labels[vs[i + 1]] THEN labels[us[i + 1]] ELSE x END) END,
              labels[us[i + 1]] <> labels[vs[i + 1]] FROM step, ends WHERE i < len(us))
        SELECT u AS src, v AS dst, w AS weight FROM step JOIN r USING (i) WHERE taken"""


KNN_DOCS = knn_sql()

ORACLES: dict[str, str] = {
    "spanning_forest_docs": forest_sql(docs_graph()),
    "map_edges": forest_sql(docs_graph()),
    "pca_uncorrelated": "SELECT t AS test, true AS ok FROM range(8) r(t)",
    "kll_profile_bounds": "SELECT p AS percentile, true AS within FROM range(0, 100, 2) r(p)",
    "scan_csv": "SELECT p_name AS smiles FROM part",
    "scan_csv_mixed_headers": "SELECT p_name AS smiles FROM part",
    "scan_tsv_bz2": "SELECT p_type FROM part",
    "scan_columns": """SELECT count(*) AS n_rows, round(sum(l_extendedprice), 2) AS sum_l_extendedprice,
        round(sum(l_quantity), 2) AS sum_l_quantity, round(sum(l_discount), 2) AS sum_l_discount FROM lineitem""",
    "scan_lenient": "SELECT o_orderkey, o_totalprice, 'orders' AS stem FROM orders",
    "file_ledger": """SELECT o_orderstatus AS kind, 'intact' AS status, NULL::VARCHAR AS reason, count(*) AS n_rows,
        count(*) AS n_decoded FROM orders GROUP BY o_orderstatus
        UNION ALL SELECT 'empty', 'empty', NULL, 0, 0
        UNION ALL SELECT 'cut', 'unreadable', 'no footer at the end: cut off', 0, 0
        UNION ALL SELECT 'text', 'unreadable', 'not a parquet file', 0, 0""",
    "union_files": """SELECT doc_id AS id, md5(text) AS text_md5 FROM documents UNION ALL
        SELECT item_id, md5(text) FROM benchmark UNION ALL SELECT conv_id, md5(text) FROM conversations""",
    "chunk_plan_orders": """SELECT o_orderstatus, count(*) AS n_rows, ceil(count(*) / 6050)::BIGINT AS n_chunks
        FROM orders GROUP BY o_orderstatus""",
    "chunk_id_orders": """SELECT o_orderkey, o_orderstatus,
        (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 1000 AS chunk_id FROM orders""",
    "chunk_id_file_order": """SELECT o_orderkey,
        (row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) - 1) // 100 AS chunk_id FROM orders""",
    "widen_embeddings": "SELECT vec_id, "
    + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS fp_{i + 1}" for i in range(WIDTH))
    + " FROM embeddings",
    "vector_of_prices": "SELECT l_orderkey, l_linenumber, 3::BIGINT AS width, round(l_discount, 4) AS fp_3 FROM lineitem",
    "featurize_with_descriptors": f"""WITH {described(PARTS, "p_partkey")}
        SELECT p_partkey, {counts_sql("smiles", X.SMILES_PATTERNS)} AS fp,
        CASE WHEN ok THEN n_heavy END AS hac, {FRACTION} AS fraction FROM d""",
    "quarantine_smiles": f"""WITH {described(f"SELECT p_partkey AS id, {smiles_sql('p_partkey')} AS smiles FROM part UNION ALL SELECT doc_id, text FROM documents", "id")}
        SELECT id, CASE WHEN trim(smiles, ' ') = '' THEN 'empty' WHEN ok THEN 'good' ELSE 'not lexically valid' END AS status FROM d""",
    "tail_count": "SELECT count(*) AS n_rows FROM lineitem WHERE l_extendedprice < 20000",
    "property_projection": f"""WITH {described(PARTS, "p_partkey")}
        SELECT p_partkey, CASE WHEN ok THEN n_heavy END AS hac, {FRACTION} AS frac_aromatic,
        CASE WHEN ok THEN len(labels) // 2 END AS num_rings,
        NULL::DOUBLE AS clogp, NULL::DOUBLE AS frac_csp3, NULL::DOUBLE AS mw FROM d""",
    "encode_docs": """SELECT doc_id,
        CASE WHEN NOT starts_with(text, 'T') THEN length(text) || ',' || (length(text) - length(replace(text, 'a', '')))
          || ',' || (length(text) - length(replace(text, ' ', ''))) END AS fp,
        CASE WHEN starts_with(text, 'T') THEN 'ValueError: starts with T' END AS error FROM documents""",
    "hashed_bits_docs": f"""WITH {BITS}, j AS (SELECT doc_id, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bits FROM bits GROUP BY doc_id)
        SELECT doc_id, bits FROM documents LEFT JOIN j USING (doc_id)""",
    "dense_bits_docs": f"""WITH {BITS}, j AS (SELECT doc_id, count(*) AS n FROM bits GROUP BY doc_id)
        SELECT doc_id, 1024::BIGINT AS width, n AS n_set FROM documents LEFT JOIN j USING (doc_id)""",
    "minhash_docs": f"""WITH {signatures(PERMUTATIONS, 3)}
        SELECT doc_id, array_to_string(s, ',') AS sig FROM documents LEFT JOIN sig USING (doc_id)""",
    "hashed_bits_smiles": f"""WITH {bits_of(PART_UNITS)}, j AS (SELECT doc_id, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bits FROM bits GROUP BY doc_id)
        SELECT p_partkey, bits FROM part LEFT JOIN j ON doc_id = p_partkey""",
    "minhash_smiles": f"""WITH {signatures(PERMUTATIONS, 3, PART_UNITS)}
        SELECT p_partkey, array_to_string(s, ',') AS sig FROM part LEFT JOIN sig ON doc_id = p_partkey""",
    "mapc_docs": f"""WITH {signatures(16, 2)}
        SELECT doc_id, array_to_string(s, ',') AS sig FROM documents LEFT JOIN sig USING (doc_id)""",
    "count_profile_docs": f"SELECT doc_id, {counts_sql('text', X.TEXT_PATTERNS)} AS counts FROM documents",
    "count_profile_pages": f"SELECT page_id, {counts_sql('html', X.TEXT_PATTERNS)} AS counts FROM pages",
    "descriptors_parts": f"""WITH {described(PARTS, "p_partkey")}
        SELECT p_partkey, smiles, CASE WHEN ok THEN n_heavy END AS hac, CASE WHEN ok THEN n_aromatic END AS num_aromatic_atoms,
        CASE WHEN ok THEN len(labels) // 2 END AS number_of_rings, {FRACTION} AS fraction_aromatic_atoms FROM d""",
    "moments_embeddings": COVARIANCES,
    "moments_update": COVARIANCES,
    "moments_bad_rows": COVARIANCES.replace("FROM embeddings,", "FROM (SELECT * FROM embeddings WHERE vec_id % 10 > 2),"),
    "stream_moments": COVARIANCES,
    "pca_all_components": NORMS,
    "pca_saved_model": NORMS,
    "stream_project": NORMS,
    "pca_spectrum": f"""WITH {COVARIANCE},
        c AS (SELECT a.dim AS i, b.dim AS j, covar_samp(a.x, b.x) AS c FROM v a JOIN v b USING (vec_id) GROUP BY a.dim, b.dim)
        SELECT {WIDTH}::BIGINT AS n_components, round(sum(CASE WHEN i = j THEN c END), 5) AS total,
        round(sum(c * c), 5) AS squared, (SELECT count(*) FROM embeddings) AS n_rows FROM c""",
    "edges_price": f"""WITH q AS (SELECT quantile_cont(l_extendedprice, {probs(50)}) AS e FROM lineitem)
        SELECT i AS edge, round(e[i + 1], 4) AS value FROM q, range(51) r(i)""",
    "edges_by_flag": f"""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, {probs(29)}) AS e FROM lineitem GROUP BY l_returnflag)
        SELECT l_returnflag, i AS edge, round(e[i + 1], 4) AS value FROM q, range(30) r(i)""",
    "edges_sorted": f"""WITH q AS (SELECT l_linestatus, quantile_cont(l_discount, {probs(11)}) AS e FROM lineitem GROUP BY l_linestatus)
        SELECT l_linestatus, i AS edge, round(e[i + 1], 4) AS value FROM q, range(12) r(i)""",
    "edges_min_max": """SELECT 0::BIGINT AS edge, round(min(l_extendedprice), 4) AS value FROM lineitem
        UNION ALL SELECT 1, round(max(l_extendedprice), 4) FROM lineitem""",
    "sketch_stored": """SELECT count(*) AS n_rows, min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max,
        min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max FROM lineitem""",
    "percentile_profile": f"""WITH q AS (SELECT quantile_cont(l_extendedprice, {probs(50)}) AS e FROM lineitem)
        SELECT i * 2 AS percentile, round(e[i + 1], 4) AS value FROM q, range(50) r(i)""",
    "iqr_fence": """WITH q AS (SELECT quantile_cont(p_size, [0.25, 0.75]) AS a, quantile_cont(p_retailprice, [0.25, 0.75]) AS b FROM part)
        SELECT round(a[2] + 1.5 * (a[2] - a[1]), 4) AS p_size_fence, round(b[2] + 1.5 * (b[2] - b[1]), 4) AS p_retailprice_fence FROM q""",
    "iqr_fence_by_brand": """WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, [0.25, 0.75]) AS b FROM part GROUP BY p_brand)
        SELECT p_brand, round(b[2] + 1.5 * (b[2] - b[1]), 4) AS p_retailprice_fence FROM q""",
    "iqr_filter": f"""WITH q AS (SELECT o_orderstatus, quantile_cont({SQUARE}, [0.25, 0.75]) AS b FROM orders GROUP BY o_orderstatus)
        SELECT o_orderkey FROM orders JOIN q USING (o_orderstatus) WHERE {SQUARE} <= b[2] + 1.5 * (b[2] - b[1])""",
    "iqr_clip": f"""WITH q AS (SELECT quantile_cont({SQUARE}, [0.25, 0.75]) AS b FROM orders)
        SELECT o_orderkey, round(least({SQUARE}, b[2] + 1.5 * (b[2] - b[1])), 2) AS square FROM orders, q""",
    "iqr_missing": f"""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 THEN {SQUARE} END AS square FROM orders),
        q AS (SELECT quantile_cont(square, [0.25, 0.75]) AS b FROM s), f AS (SELECT *, b[2] + 1.5 * (b[2] - b[1]) AS fence FROM s, q)
        SELECT o_orderkey, 'kept' AS how, NULL::DOUBLE AS square FROM f WHERE square IS NULL OR square <= fence UNION ALL
        SELECT o_orderkey, 'clipped', CASE WHEN square IS NOT NULL THEN round(least(square, fence), 2) END FROM f""",
    "bins_price": f"""WITH q AS (SELECT quantile_cont(l_extendedprice, {probs(50)}) AS e FROM lineitem)
        SELECT l_orderkey, l_linenumber, {binned("l_extendedprice", "e", 50)} AS bin FROM lineitem, q""",
    "bins_with_gaps": f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE
        ELSE floor(value / 10) - 1 END AS x FROM events)
        SELECT event_id, {binned("x", "[0.0, 1.0, 1.0, 3.0, 4.0]::DOUBLE[]", 4)} AS bin FROM x""",
    "grid_lineitem": f"WITH {CELLS} SELECT c1 * 25 + c2 * 5 + c3 AS cluster_id, count(*) AS n_rows FROM b3 GROUP BY 1",
    "grid_customer": f"""WITH e1 AS (SELECT quantile_cont(c_acctbal, {probs(4)}) AS e FROM customer),
        b1 AS (SELECT c_custkey, c_nationkey, {binned("c_acctbal", "e", 4)} AS c1 FROM customer, e1),
        e2 AS (SELECT c1, quantile_cont(c_nationkey, {probs(3)}) AS e FROM b1 GROUP BY c1)
        SELECT c_custkey, c1 AS cluster_id_1, {binned("c_nationkey", "e", 3)} AS cluster_id_2 FROM b1 JOIN e2 USING (c1)""",
    "create_clusters": f"WITH {CELLS} SELECT l_orderkey, l_linenumber, c1 * 25 + c2 * 5 + c3 AS cluster_id FROM b3",
    "grid_saved_model": f"WITH {CELLS} SELECT l_orderkey, l_linenumber, c1 * 25 + c2 * 5 + c3 AS cluster_id FROM b3",
    "cell_labels": f"WITH {CELLS} SELECT l_orderkey, l_linenumber, concat_ws('_', c1, c2, c3) AS label FROM b3",
    "cell_decode": """SELECT o_orderkey, o_orderkey // 420 AS cluster_id_1, (o_orderkey // 7) % 60 AS cluster_id_2,
        o_orderkey % 7 AS cluster_id_3, o_orderkey AS again FROM orders""",
    "label_parse": """SELECT c_custkey, c_custkey % 4 > 0 AS good, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey::BIGINT END AS cluster_id_1,
        CASE WHEN c_custkey % 4 > 0 THEN c_custkey END AS cluster_id_2,
        CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 10 END AS cluster_id_3 FROM customer""",
    "select_cell": f"WITH {CELLS} SELECT l_orderkey, l_linenumber FROM b3 WHERE c1 = 2 AND c2 = 1 AND c3 = 3",
    "sink_grid": f"WITH {CELLS} SELECT l_orderkey, l_linenumber FROM b3 WHERE c1 = 1 AND c2 = 4 AND c3 = 0",
    "representatives": """WITH c AS (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY c_nationkey),
        d AS (SELECT c_nationkey, c_custkey, c_name, abs(c_acctbal - m) AS d FROM customer JOIN c USING (c_nationkey))
        SELECT c_nationkey, c_custkey, c_name, round(d, 4) AS distance FROM d
        QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY d, c_custkey) = 1""",
    "knn_docs": KNN_DOCS,
    "knn_duplicates": KNN_DOCS,
    "knn_near_copies": f"SELECT src, dst, matches, rank FROM ({knn_sql(NEAR_COPIES)})",
    "knn_coords": f"SELECT src, dst, round(weight, 5) AS weight, rank FROM ({coords_sql('c_acctbal', 'c_nationkey')})",
    "knn_cells": f"SELECT src, dst, round(weight, 5) AS weight, rank FROM ({coords_sql('c_acctbal', 'c_nationkey', '(c_custkey % 97)')})",
    "knn_vectors": VECTOR_KNN,
    "map_by_coords": forest_sql(coords_sql("c_acctbal", "c_nationkey")),
    "node_labels": """WITH n AS (SELECT p_partkey, p_name, p_brand || '__' || CASE WHEN p_size > 5 THEN p_size::VARCHAR ELSE 'Unknown' END AS l FROM part)
        SELECT p_partkey, p_name || '__' || l AS label,
        p_name || '__<a href="/generate/' || l || '" target="_blank">' || l || '</a>' AS linked FROM n""",
    "category_codes": """WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment FROM customer)
        SELECT c_custkey, segment, dense_rank() OVER (ORDER BY coalesce(segment, 'Unknown')) - 1 AS segment_code FROM s""",
    "map_nodes": f"""WITH {described(f"SELECT c_custkey, c_mktsegment, {smiles_sql('c_custkey')} AS smiles FROM customer", "c_custkey, c_mktsegment")}
        SELECT c_custkey, smiles || '__' || c_mktsegment AS label, CASE WHEN ok THEN n_heavy END AS hac,
        CASE WHEN ok THEN len(labels) // 2 END AS num_rings,
        dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_code FROM d""",
    "sink_clusters": "SELECT o_custkey % 125 AS cluster_id, count(*) AS n_rows FROM orders GROUP BY 1",
    "sink_csv": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders",
    "sink_parquet_once": "SELECT s_suppkey, s_name FROM supplier",
    "sink_append": "SELECT c_custkey, c_acctbal FROM customer",
    "pending_chunks": f"SELECT o_orderkey, o_orderstatus, {CHUNKS} AS chunk_id FROM orders QUALIFY o_orderstatus <> 'F'",
    "resumed_run": f"SELECT o_orderkey, o_orderstatus, {CHUNKS} AS chunk_id FROM orders",
    "stream_sketch": "SELECT event_type, count(*) AS n_rows, min(value) AS low, max(value) AS high FROM events GROUP BY event_type",
    "stream_assign": f"""WITH e1 AS (SELECT quantile_cont(value, {probs(5)}) AS e FROM events),
        b1 AS (SELECT event_id, user_id, {binned("value", "e", 5)} AS c1 FROM events, e1),
        e2 AS (SELECT c1, quantile_cont(user_id, {probs(4)}) AS e FROM b1 GROUP BY c1)
        SELECT event_id, c1 * 4 + {binned("user_id", "e", 4)} AS cluster_id FROM b1 JOIN e2 USING (c1)""",
}
