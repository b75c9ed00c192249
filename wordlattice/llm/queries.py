"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordlattice.llm import arc, bpe, decontam, embdedup, jaccard, langid, oracles, pii, quality, tokenfile, toxicity
from wordlattice.llm.common import fold, table


def op1_quality(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.train(documents, labels, fold("doc_id", 3) != 1)
    held = documents.withColumn("held_out", fold("doc_id", 3) == 1)
    return quality.predict(held, model).select("doc_id", "held_out", "score", "predicted")


def op2_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op3_arc_to_warc(spark, sf_dir):
    return arc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_embedding_dedup(spark, sf_dir):
    return embdedup.join(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op5_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op6_decontaminate(spark, sf_dir):
    documents, benchmark = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontam.report(documents, benchmark).drop("text")


def op7_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    prototypes = langid.train(documents.where(fold("doc_id", 4) != 2))
    held = documents.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    return langid.predict(held, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def op8_toxicity(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(documents, labels, fold("doc_id", 5) != 0)
    held = documents.withColumn("held_out", fold("doc_id", 5) == 0)
    return toxicity.predict(held, model).select("doc_id", "held_out", "score", "predicted")


def op9_token_files(spark, sf_dir):
    return tokenfile.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), special=True)


def op10_ngram_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents", "doc_id", "text"))


_ALL = op1_quality, op2_byte_bpe, op3_arc_to_warc, op4_embedding_dedup, op5_pii, op6_decontaminate, op7_language_id, op8_toxicity, op9_token_files, op10_ngram_jaccard
QUERIES = {f.__name__: f for f in _ALL}

#: The same in DuckDB's SQL, where SQL can express it.
ORACLES: dict[str, str] = {
    "op3_arc_to_warc": oracles.ARC,
    "op4_embedding_dedup": oracles.EMBEDDINGS,
    "op6_decontaminate": oracles.DECONTAMINATE,
    "op10_ngram_jaccard": oracles.JACCARD,
}
