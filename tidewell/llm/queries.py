"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def tokenizer_path() -> str:
    """The vocabulary file: TIDEWELL_TOKENIZER names another than the public byte_bpe_50k.json."""
    if path := os.environ.get("TIDEWELL_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ship(spark: SparkSession) -> None:
    """Send the package to executors that cannot import it from their path or working folder."""
    root = Path(__file__).resolve().parents[2]
    near = {Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    if root in near or getattr(spark.sparkContext, "_tidewell_shipped", False):
        return
    folder = tempfile.mkdtemp()  # of the driver, which serves the file to executors as long as it runs
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tidewell", "zip", root, "tidewell"))
    spark.sparkContext._tidewell_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_block_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_blocks import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import judged

    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fuzzy_lines import drop_lines

    return drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .orc_tokens import tokens_written_and_read

    return tokens_written_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .slack_packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity_cnn import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .soft_mixing import document_rates

    return document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("__doc")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_cnn import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ball_tree import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_suffix_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_language_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_bayes import identified

    return identified(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_block_pruning, op2_distribution_divergence, op3_hidden_markov, op4_fuzzy_lines, op5_orc_tokens, op6_minimum_bin_slack, op7_toxicity_cnn)
    return {f.__name__: f for f in (*first, op8_soft_mixing, op9_order_minhash, op10_byte_cnn, op11_ball_tree_negatives, op12_suffix_importance, op13_language_bayes)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


#: SQL for the operators that it can express.
ORACLES = {
    "op1_block_pruning": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
      FROM q JOIN v d ON d.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op11_ball_tree_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, min(v) AS v, arg_min(label, v) AS label FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS anchor_id, d.vec_id, CAST(list_dot_product(a.v, d.v) AS BIGINT) AS score, a.label = d.label AS same FROM a JOIN v d ON d.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
      CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
}


def importance_sql() -> str:
    """The oracle of op12; crc32 goes half a byte at a time, as DuckDB has none."""
    nibbles = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        nibbles.append(f"{c}::BIGINT")
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"list_filter(string_split_regex({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return IMPORTANCE.replace("{words}", words).replace("{nibbles}", f"[{', '.join(nibbles)}]")


IMPORTANCE = """
WITH words AS (SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS row, {words} AS w FROM documents
          UNION ALL SELECT 1, item_id, 0, {words} FROM benchmark),
grams AS (SELECT kind, id, row, len(w) AS n, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
          list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS g FROM words),
found AS (SELECT g, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM grams GROUP BY g),
coded AS (SELECT g, s, t, hex(encode(g)) AS h FROM found),
nibbles AS (SELECT g, s, t, list_transform(range(0, len(h)), lambda i: strpos('0123456789ABCDEF', substr(h, CAST(xor(i, 1) AS BIGINT) + 1, 1)) - 1) AS b FROM coded),
hashed AS (SELECT g, s, t, xor(list_reduce(b, lambda c, x: xor(c >> 4, ({nibbles})[CAST(xor(c, x) & 15 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM nibbles),
counts AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM counts) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM counts) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counts),
weights AS (SELECT row, sum(gain) AS weight FROM grams JOIN hashed USING (g) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY row),
scored AS (SELECT id AS doc_id, len(w) AS n, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise FROM words LEFT JOIN weights USING (row) WHERE kind = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY weight + noise DESC, doc_id, n_features, weight) AS r, count(*) FILTER (WHERE n >= 20) OVER () AS long_enough FROM scored)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n >= 20 AND r <= 5 * long_enough // 100 THEN r END AS rank FROM ranked
"""
ORACLES["op12_suffix_importance"] = importance_sql()
