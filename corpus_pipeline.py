"""A corpus pipeline: language ID, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Stage outputs are written as Parquet to the
shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wordlattice.llm import bpe, decontam, jaccard, langid, pii
from wordlattice.llm.common import stored, table, unused


def language_id(spark, docs, sf_dir):
    """Learns languages from the labelled rows of ``docs``; texts that are null or have no letter go."""
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    found = langid.predict(docs, langid.train(docs), into=(lang, score))
    return found.where(F.col(lang) != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of documents linked by the n-gram Jaccard join, the one with the smallest id stays."""
    return jaccard.keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    out = decontam.filter_spans(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mask_pii(spark, docs, sf_dir):
    """Personal data is replaced by its kind in brackets."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def tokenize(spark, docs, sf_dir):
    """doc_id, token ids and the digests of the encoding and of what it decodes to."""
    return bpe.round_trip(docs.select("doc_id", "text"), keep_ids=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mask_pii", mask_pii),
    ("tokenize", tokenize),
]

#: Language ID and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over ``documents``, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
