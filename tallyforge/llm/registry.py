"""The queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from tallyforge.llm import alignment, centroids, chunking, decontaminate, extraction, langid, ngram, packing, privacy, probminhash, repair, toxicity, urls
from tallyforge.llm.common import table


def op1_repair(spark, sf_dir):
    """All documents as ids in grammar blocks, read back."""
    blocks = repair.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return repair.read_shards(blocks)


def op2_nnpu(spark, sf_dir):
    """Toxicity of all documents."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chunking(spark, sf_dir):
    """All documents' payloads as deduplicated chunks, read back."""
    return chunking.media(table(spark, sf_dir, "documents"))


def op4_bytecnn(spark, sf_dir):
    """Language of all documents."""
    return langid.language(table(spark, sf_dir, "documents"))


def op5_kneser_ney(spark, sf_dir):
    """Log probabilities of all documents."""
    return ngram.perplexity(table(spark, sf_dir, "documents"))


def op6_redirects(spark, sf_dir):
    """Verdicts of all pages."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_probminhash(spark, sf_dir):
    """Classes of near-duplicate documents."""
    return probminhash.classes(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    """All documents' ids in windows of 2048."""
    pieces = packing.cut(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1)
    return packing.pack(pieces).drop("ids")


def op9_disclosure(spark, sf_dir):
    """Personal data in all documents."""
    return privacy.digest(privacy.find(table(spark, sf_dir, "documents")))


def op10_spaced_seeds(spark, sf_dir):
    """Passages of the benchmark in all documents."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_threshold(spark, sf_dir):
    """Clusters of all vectors."""
    return centroids.digest(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op12_lstm(spark, sf_dir):
    """Main text of all pages."""
    return extraction.extract(table(spark, sf_dir, "pages"))


def op13_alignment(spark, sf_dir):
    """Tokens of two vocabularies aligned in all documents."""
    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run, "op1_repair": op1_repair, "op2_nnpu": op2_nnpu, "op3_chunking": op3_chunking, "op4_bytecnn": op4_bytecnn, "op5_kneser_ney": op5_kneser_ney, "op6_redirects": op6_redirects, "op7_probminhash": op7_probminhash, "op8_packing": op8_packing, "op9_disclosure": op9_disclosure, "op10_spaced_seeds": op10_spaced_seeds,
        "op11_threshold": op11_threshold, "op12_lstm": op12_lstm, "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_redirects": urls.SQL, "op11_threshold": centroids.SQL}
