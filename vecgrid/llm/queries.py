"""One query per operator of this subpackage: name -> (spark, folder) -> DataFrame, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrid.llm import (
    bpe_tree,
    exact_dedup,
    html_extract,
    langid,
    packing,
    piece_codec,
    ranked_search,
    simhash,
    spelling,
    token_count,
    toxicity,
    vector_search,
    warc,
)
from vecgrid.llm.common import fold, table
from vecgrid.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    """Place of a file of the installed public tokenisers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").filter(fold("doc_id", 5) != 0)
    model = toxicity.fit(toxicity.training_sample(docs, labels))
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), toxicity.scorer(model)(F.col("text")).alias("r"))
    return scored.select(
        "doc_id", "held_out", "r.score", (F.col("r.score") >= 0.5).cast("int").alias("predicted"), "r.offending"
    )


@query
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    profiles = langid.fit_profiles(docs.filter(fold("doc_id", 3) != 1))
    got = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), langid.predictor(profiles)(F.col("text")).alias("r"))
    return got.select("doc_id", "held_out", "r.lang_pred", "r.score")


@query
def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf, "pages"), path)
    found = warc.records(warc.read(spark, path))
    return found.select(
        F.col("record_id").try_cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").try_cast("bigint").alias("refers_to"),
    )


HEX32_SQL = "||".join(
    f"substr('{warc.BASE32}', ((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {s}) & 31) + 1, 1)"
    for i in range(8)
    for s in (15, 10, 5, 0)
)
ORACLES["op3_warc"] = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {HEX32_SQL} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g"""


@query
def op4_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    model = html_extract.fit(html_extract.layouts() + html_extract.labelled_sample(pages))
    got = pages.select("page_id", "url", html_extract.extractor(model)(F.col("html")).alias("r"))
    return got.select("page_id", "url", "r.text", F.length("r.text").cast("bigint").alias("n_chars"))


@query
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    return token_count.count_tokens(table(spark, sf, "documents"), lambda: token_count.Vocabulary.of_piece_model(path), max_word=None)


@query
def op6_piece_codec(spark: SparkSession, sf: str) -> DataFrame:
    encode = piece_codec.codec(tokenizer_file("piece_bpe_32k.model"), with_texts=False)
    got = table(spark, sf, "documents").select("doc_id", encode(F.col("text")).alias("r"))
    return got.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


@query
def op7_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


ORACLES["op7_exact_topk"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS query_id, b.vec_id,
                  coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0)::BIGINT AS score
           FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query
def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    got = simhash.near_groups(table(spark, sf, "documents"))
    return got.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


@query
def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), byte_encoder(added=True), with_ids=False)


def byte_encoder(added: bool = False) -> Callable[[], packing.RankEncoder]:
    """Encoder by the public byte-level vocabulary; ``added``: with the added tokens of its JSON file, as the library has it."""
    from public_tokenizers import PATTERN

    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    tokens = packing.added_tokens(tokenizer_file("byte_bpe_50k.json")) if added else None
    return lambda: packing.RankEncoder(ranks, PATTERN, added=tokens)


@query
def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = exact_dedup.dedup_batch(table(spark, sf, "documents"), exact_dedup.new_index_name())
    return got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op10_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
           FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""


@query
def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.top_k(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLES["op11_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL} AS t FROM documents),
     c AS (SELECT count(*)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
     p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
     w AS (SELECT term, floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
     m AS (SELECT r, doc_id, 10 + (90 * len(t) * nn) // ll AS m FROM d, c WHERE len(t) > 0),
     i AS (SELECT item_id, unnest(list_distinct({TERMS_SQL})) AS term FROM benchmark),
     s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
     k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""


@query
def op12_bpe_tree(spark: SparkSession, sf: str) -> DataFrame:
    from public_tokenizers import PATTERN

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    got = bpe_tree.encode_documents(table(spark, sf, "documents"), path, PATTERN, with_values=False)
    return got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents"))


def _crc_entry(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


CRC_TABLE_SQL = "[" + ", ".join(str(_crc_entry(b)) for b in range(256)) + "]"
ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE r AS (
       SELECT doc_id, run, count(*)::BIGINT AS n
       FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY doc_id, run),
     b AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM r),
     c AS (SELECT run, n, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                  lambda s, x: xor({CRC_TABLE_SQL}[(xor(s, x) & 255) + 1], s >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM b),
     w AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM c),
     v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
     e AS (SELECT word, i, length(word) AS size, substr(word, 1, i - 1) || substr(word, i + 1) AS g
           FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
     p AS (SELECT a.word AS x, b.word AS y FROM e a JOIN e b ON a.g = b.g AND a.i = b.i AND a.size = b.size AND a.word <> b.word
           UNION SELECT e.word, v.word FROM e JOIN v ON v.word = e.g UNION SELECT v.word, e.word FROM e JOIN v ON v.word = e.g),
     q AS (SELECT x AS word, y AS near, v.n AS m, count(*) OVER (PARTITION BY x) AS n_near,
                  row_number() OVER (PARTITION BY x ORDER BY v.n DESC, encode(y)) AS k FROM p JOIN v ON v.word = y),
     f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * v.n THEN near END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
           FROM v LEFT JOIN (SELECT * FROM q WHERE k = 1) q ON q.word = v.word),
     t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word JOIN f AS last ON last.word = t.root WHERE last.form IS NULL"""

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
