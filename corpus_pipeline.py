"""The corpus pipeline: documents -> toxicity -> near duplicates -> personal data -> mixture -> tokens.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns the columns of
documents, but for the last, which returns token ids. run() writes every stage's rows to the shared folder and reads them
again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintree.llm.bpe import encode_documents
from twintree.llm.common import Scratch, table
from twintree.llm.jaccard_join import keep_one
from twintree.llm.mixing import mix
from twintree.llm.queries import tokenizer_model
from twintree.llm.surrogates import replace_entities
from twintree.llm.toxicity import fit_toxicity, score_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from sf_dir's labels of these documents.

    Cases: null and empty texts are scored as empty ones; a null id is scored but never learned from; rows that repeat an id
    are scored one by one; without labels of both kinds all documents have the same score: that of their mean; an empty
    table stays empty; columns beyond those of documents go.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs.select(*COLUMNS), model).where(F.col("predicted") == 0).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the smallest id: five-word shingles, similarity 0.8.

    Cases: documents without words (null, empty, white space) link with nothing and stay; so do rows with a null id; of rows
    that repeat an id the one whose text has the smallest SHA-256 stays (null last, any of equal rows); a text of fewer than
    five words is one shingle; an empty table stays empty.
    """
    return keep_one(docs.select(*COLUMNS), words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; no document goes and n_chars is that of the new text.

    Cases: null texts stay null, empty ones empty; repeated rows are rewritten alike; a null id does not matter; an empty
    table stays empty.
    """
    return replace_entities(docs.select(*COLUMNS)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to tempered source, language and topic shares, 70 % of the words.

    Cases: null sources and languages are values of their own; null and empty texts have no words and the chance of their
    cell, 1 if the cell has none; rows that repeat an id are drawn alike, null ids as the text "null"; an empty table stays
    empty.
    """
    return mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256, a row for each document.

    Cases: null texts count as empty, with no ids; null ids, languages and sources are handed through; repeated rows are
    encoded alike; an empty table gives an empty result.
    """
    out = encode_documents(docs, tokenizer_model(), keep_output=("ids",), keep_columns=("lang", "source"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: A trained classifier, trie join and tokenizer have no SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
