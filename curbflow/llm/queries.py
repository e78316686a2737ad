"""The contract queries of the operators in this folder, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit import best_fit_packed
from .common import id_remainder, table
from .decontaminate import contamination
from .hard_negatives import hard_negatives
from .hidden_markov import hidden_markov_scores
from .inner_products import top_products
from .language_id import language_id, train_language_id
from .near_duplicates import near_duplicates
from .packing import packed
from .prefix_trie import prefix_trie
from .repeats import without_repeats
from .secrets import secret_spans, span_text
from .token_counts import token_counts
from .toxicity import labelled_texts, score_toxicity, train_toxicity


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hidden_markov_scores(docs, id_remainder(F.col("doc_id"), 7) == 2)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = train_language_id(docs.where(~held_out))
    return language_id(docs.select("doc_id", "text"), trees).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op3_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(labelled_texts(docs, table(spark, sf_dir, "labels").where(~held_out)))
    return score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secrets")

    def of(kind: str):
        return F.filter(spans, lambda x: x["kind"] == kind)

    base = F.filter(spans, lambda x: x["kind"].isin("assign", "access", "hex"))
    return secret_spans(docs).select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed(docs, tokenizer("word_bpe_49k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit_packed(docs, tokenizer("byte_bpe_50k.json"), carry={"ids_crc32": F.crc32("ids")}).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id")
    kept = F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(9))
    return prefix_trie(table(spark, sf_dir, "conversations"), 8, conv_id - conv_id % 5, kept)


QUERIES = {
    "op1_hidden_markov": op1_hidden_markov,
    "op2_language_id": op2_language_id,
    "op3_top_products": op3_top_products,
    "op4_toxicity": op4_toxicity,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_counts": op6_token_counts,
    "op7_secret_scan": op7_secret_scan,
    "op8_repeats": op8_repeats,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op5_near_duplicates": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
            FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY 1
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), e AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
        ), both_ways AS (
            SELECT a, b FROM e UNION SELECT b, a FROM e
        ), r(a, b) AS (
            SELECT a, b FROM both_ways UNION SELECT r.a, f.b FROM r JOIN both_ways f ON r.b = f.a
        ), least_of AS (
            SELECT a, min(b) AS c FROM r GROUP BY 1
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(c, d.doc_id), d.doc_id) AS component_id,
               least(coalesce(c, d.doc_id), d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of ON least_of.a = d.doc_id
    """,
    "op10_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(text, {FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
        ), bw AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
            FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0
        ), dw AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM d, (SELECT DISTINCT n FROM bw) k, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)
        ), hits AS (
            SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
        ), words AS (
            SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) t(j) GROUP BY 1
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
    """,
    "op3_top_products": """
        WITH usable AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_inner_product([CAST(x AS DOUBLE) FOR x IN q.v], [CAST(x AS DOUBLE) FOR x IN c.v]) AS BIGINT) AS score
            FROM usable q JOIN usable c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op12_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [CAST(CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
                   CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
            FROM usable a JOIN usable c ON c.vec_id <> a.vec_id AND len(a.v) = len(c.v)
            WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score
            FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same)
            WHERE place <= 5
        ), ranked AS (
            SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id AS negative_id, positive_score, score AS negative_score
            FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
             AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        )
        SELECT * FROM ranked WHERE rank <= 5
    """,
    # the inner list_reduce is a byte's eight steps of the CRC-32 with the reflected polynomial 0xEDB88320
    "op13_prefix_trie": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, conv_id - conv_id % 5 AS source, xor(list_reduce(
                list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
                lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)),
                CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM t)
        ), r AS (
            SELECT c.conv_id, 0 AS side, i, role, text FROM c JOIN t ON t.conv_id = source AND i < h
            UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i >= h
        ), p AS (
            SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
                   array_to_string(list(sha256(role || chr(1) || text)) OVER w, ',') AS key
            FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY side, i)
        ), members AS (
            SELECT conv_id, depth, bytes, key, regexp_replace(key, ',?[0-9a-f]*$', '') AS up FROM p
            UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c
        ), n AS (
            SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(up) AS up, count(*) AS n_convs,
                   (count(*) - 1) * any_value(bytes) AS saved
            FROM members GROUP BY key
        ), k AS (
            SELECT up AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up
        ), s AS (
            SELECT x.key, count(*) FILTER (k.key IS NULL) AS n_leaves, CAST(sum(y.saved) AS BIGINT) AS saved_tokens
            FROM n x JOIN n y ON starts_with(y.key, x.key) LEFT JOIN k ON k.key = y.key GROUP BY x.key
        ), ends AS (
            SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
            FROM (SELECT conv_id, max_by(key, depth) AS key FROM members GROUP BY conv_id) GROUP BY key
        )
        SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
               saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM n JOIN s ON s.key = n.key LEFT JOIN n m ON m.key = n.up LEFT JOIN k ON k.key = n.key LEFT JOIN ends ON ends.key = n.key
    """,
}
