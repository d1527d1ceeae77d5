"""A pipeline over documents: toxicity, line dedup, near-dedup (SimHash, then MinHash where it is blind), decontamination, BPE encoding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the frame that the next stage reads. All but
the last return the columns of documents. ``run`` applies them to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontam, linededup, nearcopies, toxicity
from tidemark.llm.common import Scratch, table
from tidemark.llm.queries import tokenizer_file

#: A document whose toxicity score reaches this is rejected.
TOXIC = 0.3
#: Code points of a line for each edit by which it may differ from an earlier one.
LINE_EDIT = 12


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from labels of the folder's documents, as the query does."""
    model = toxicity.train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity_score(docs, model) < TOXIC)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, or come within two edits of it and one edit in LINE_EDIT code points.

    A line of a few letters that differs in two of them is another line: without the share, short texts would go.
    """
    return linededup.drop_repeated_lines(docs, per=LINE_EDIT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id. Rows that repeat it go as well.

    SimHash finds pairs as in op2_simhash, MinHash those beyond its budget of bits; five-word similarity 0.8 decides both.
    """
    return nearcopies.keep_one_of_each(docs, width=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left."""
    return bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: SQL can't express the stages. Tests hold near-dedup against all pairs, and the operators behind the other stages as theirs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; between stages the documents are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs)
    return docs
