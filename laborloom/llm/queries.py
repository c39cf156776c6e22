"""The dealt operators as registered queries, over their whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborloom.llm import (
    chat_trees,
    hard_negatives,
    jaccard_join,
    language_id,
    license_scans,
    mixing,
    packing,
    pair_search,
    quality_ranking,
    quality_rules,
    secret_scans,
    toxicity,
    vector_search,
)
from laborloom.llm.common import table


def tokenizer_path() -> str:
    """The public vocabulary that the packing query is stated for."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[secret_scans.count_kind(F.col("base_spans"), p.kind).alias(f"n_{p.kind}") for p in secret_scans.BASE],
        F.sha2(secret_scans.spans_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        secret_scans.spans_text(F.col("secret_spans")).alias("spans"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranking.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan_licenses(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, shifted)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = rows.unionByName(chat_trees.planted(spark))
    return chat_trees.conversation_digests(chat_trees.format_conversations(both))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scans": op2_secret_scans,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_vector_search": op5_vector_search,
    "op6_quality_ranking": op6_quality_ranking,
    "op7_license_scans": op7_license_scans,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ranked_search": op12_ranked_search,
    "op13_chat_formatting": op13_chat_formatting,
}
# The learned, tokenized, hashed or approximate results have no SQL form; tests hold them against plain versions.
SQL: dict[str, str] = {
    "op8_jaccard_join": """
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s
            FROM split),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * c >= 85 * (p.n + q.n - c)),
        steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reached AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, s.y FROM reached r JOIN steps s ON r.b = s.x)
        SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(b) AS component_id
        FROM documents d JOIN reached ON a = d.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id""",
    "op11_hard_negatives": """
        WITH scaled AS (
            SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        firsts AS (SELECT vec_id, min({'label': label, 'v': v}) AS r FROM scaled GROUP BY vec_id),
        rows_ AS (SELECT vec_id, r.label AS label, CAST(r.v AS DOUBLE[]) AS v FROM firsts),
        scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
                CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        ranked AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
            FROM positives p JOIN scores s USING (anchor_id)
            WHERE NOT alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE rank <= 3""",
    "op12_ranked_search": """
        WITH split AS (
            SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
            FROM documents),
        totals AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM split WHERE len(w) > 0),
        tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM split) GROUP BY d, t),
        asked AS (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id),
        wanted AS (
            SELECT item_id, t, count(*) AS times FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM asked)
            GROUP BY item_id, t),
        weights AS (
            SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf, totals GROUP BY t, docs),
        scores AS (
            SELECT item_id, d, CAST(sum(times * weights.w * ((1000000000 * tf) //
                (1000 * tf + 12 * (100 - 25 + (25 * len(s.w) * docs) // terms)))) AS BIGINT) AS score
            FROM wanted JOIN tf USING (t) JOIN weights USING (t) JOIN split s USING (d), totals GROUP BY item_id, d),
        ranked AS (
            SELECT item_id, doc_id, score,
                row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank
            FROM scores JOIN split USING (d) WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20""",
}
