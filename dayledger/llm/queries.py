"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayledger.llm import codes, decontaminate, fingerprints, html, jaccard, lines, mixing, neardup, quality, secrets, spelling, tokencount, toxicity
from dayledger.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity: doc_id, held_out, score, predicted."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document: doc_id, size, source_size, target, taken."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps of its lines: doc_id, n_lines, n_dropped, kept_sha256 (of an empty text where the text is null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text: page_id, url, text, n_chars."""
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; the source stands for the owner, the document for the repository."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), owner="source", repository="doc_id")
    return found.withColumn("base_sha256", F.sha2(F.col("base"), 256)).drop("base")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality: doc_id, held_out, score, predicted."""
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that overlap the benchmark; documents that aren't listed are clean."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near copies by three-word shingles: doc_id, n_shingles, component_id, kept."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens: doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component by the Jaccard similarity of five-word shingles: doc_id, n_shingles, component_id."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=5, percent=80)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's product code: vec_id, code, error, label_error, codebooks_sha256."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's near words and frequent form: word, form, root, n, n_near, form_n."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), damage=199)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_fingerprints": op5_fingerprints,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_near_dedup": op9_near_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op3_line_dedup": lines.ORACLE,
    "op6_secret_scan": secrets.ORACLE,
    "op9_near_dedup": neardup.ORACLE,
    "op11_jaccard_join": jaccard.ORACLE,
    "op12_vector_codes": codes.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
