"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm import (
    conversation_trie, fm_quality, latent_decontam, license_rules, line_windows, ngram_join, piece_sampling,
    prefix_forest, secret_links, simhash_pivot, spectrum_whitening, surrogates, token_transducer,
)
from sigframe.llm.common import table

# A key for the queries; a job passes its own.
DEMO_KEY = b"replace this key"
BPE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates, and the spans that were replaced."""
    done = surrogates.pseudonymised(table(spark, sf_dir, "documents"), DEMO_KEY)
    return done.select("doc_id", "text", F.size("spans").cast("long").alias("n_entities"), F.array_join("spans", ",").alias("spans"))


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.digest(license_rules.scan(table(spark, sf_dir, "documents")))


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated windows, and how many lines went."""
    return line_windows.dedup(table(spark, sf_dir, "documents"), "n_removed").select("doc_id", "text", "n_removed")


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.digest(secret_links.scan(table(spark, sf_dir, "documents")))


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_pivot.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_pivot.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op7_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fm_quality.train(docs, table(spark, sf_dir, "labels"))
    return fm_quality.score(docs, model, ["doc_id"]).select(
        "doc_id", fm_quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every text and whether it decodes to that text."""
    return piece_sampling.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_FILE)).select("doc_id", "ids", "n_pieces", "lossless")


def op10_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.search(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over the rebuilt conversations, with the figures of its subtree."""
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 85 % of the 4-word shingles."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op13_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's leading 16 whitened components."""
    return spectrum_whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_pii_surrogates, op2_license_rules, op3_line_windows, op4_secret_links, op5_latent_decontamination,
    op6_simhash_pivots, op7_fm_quality, op8_token_transducer, op9_piece_sampling, op10_prefix_forest, op11_prefix_trie,
    op12_ngram_join, op13_spectrum_whitening)}

# Lines are told apart by their texts, and ties by id and line: ids are unique in the given tables.
LINE_WINDOWS_SQL = """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
bare AS (SELECT doc_id, n, trim(regexp_replace(line, '[\\t\\r\\x0B\\f]', ' ', 'g'), ' ') AS x FROM lines),
three AS (SELECT doc_id, n, x, lead(n) OVER w AS n1, lead(x) OVER w AS x1, lead(n, 2) OVER w AS n2, lead(x, 2) OVER w AS x2
  FROM bare WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
later AS (SELECT doc_id, n, n1, n2 FROM (SELECT *, row_number() OVER (PARTITION BY x, x1, x2 ORDER BY doc_id, n) AS place FROM three WHERE n2 IS NOT NULL) WHERE place > 1),
gone AS (SELECT doc_id, n FROM later UNION SELECT doc_id, n1 FROM later UNION SELECT doc_id, n2 FROM later),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE g.n IS NULL) AS text, count(g.n) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN k.n_removed > 0 THEN COALESCE(k.text, '') ELSE d.text END AS text, COALESCE(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id"""

ORACLES: dict[str, str] = {"op3_line_windows": LINE_WINDOWS_SQL}
