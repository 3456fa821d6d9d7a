"""A corpus pipeline over ``documents``: each stage takes what its predecessor kept and returns documents.

1. language_id: documents of undetermined language (no text, or no letter in it) go;
2. ngram_jaccard_join: of each group of near copies the document with the least doc_id stays, and rows without an id stay;
3. substring_dedup: passages of 50 words that also stand in an earlier document are cut out of the text;
4. decontamination: documents that hold a benchmark item, within its edit budget, go;
5. sentencepiece: the texts that are left, as piece identifiers, with the round trip checked.

Defined cases: null, empty and letterless texts leave in stage 1; without any labelled document every language is
undetermined and all leave. Rows without a doc_id pass the stages that compare documents (2 and 3) unchanged and are
judged by their own text in the others. Of rows that repeat a doc_id those with equal n-grams are one document, and one
of them stays (which of them, where other columns differ, is open); different texts stay as they are. Ties between near
copies go to the least doc_id. Very long texts are read whole. Extra columns travel through stages 1 to 4, whatever
their names; stage 5 returns its own. An empty table gives an empty result; an empty benchmark removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm import decontamination, language_id, ngram_join, sentence_pieces, suffix_automata
from storelens.llm.base import discard, stash, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.reject_unknown(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs).unionByName(docs.where(docs["doc_id"].isNull()))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_automata.cut_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_checked(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: SQL expresses neither the trained language model nor the piece lattice; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs)
            discard(before)
    return docs
