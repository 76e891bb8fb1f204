"""The training-data pipeline: documents in, encoded documents of a cleaned mix out.

Every stage but the last returns the columns of its input, whatever they are called, and gives an
empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import linededup, mixing, pieces, quality, simhash
from tidemark.llm.common import materialize
from tidemark.llm.queries import table, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each row by its own text, source and language.

    A null text is judged as an empty one, null sources and languages are sites of their own, a null
    doc_id changes nothing, repeated rows share a verdict. Texts of any length are read whole.
    Without labels all rows stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten or more rows go; n_chars follows the text.

    A null or empty text is one empty line, which stays, and comes back as ''. Repeated rows each
    count, so that a row that is there ten times loses all its lines; doc_id isn't looked at.
    """
    hidden = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    out = linededup.drop_common_lines(hidden, min_docs=10, min_chars=1).select(*hidden.columns).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word Jaccard similarity of 0.8 or more stays.

    Fingerprints of 64 bits nominate pairs within four bits by pigeonring chains. At 0.8 about 15 % of
    a SimHash's bits differ, whatever its width, and keys for that radius hold too few bits to tell
    documents apart, so that bands of minima nominate what lies beyond. All candidates are compared
    by their shingles themselves. The row of the smallest doc_id stays, nulls last.
    Null texts and texts without words are one group; a text under five words is one shingle. Rows
    of one doc_id are told apart by their contents.
    """
    return simhash.keep_first_similar(docs, shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, so that sources meet their targets.

    Null sources are one source. Null texts and texts without words have size 0 and are never taken.
    Repeated rows are drawn each by itself.
    """
    return mixing.take(docs)


def sentencepiece_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids; a document that was taken twice gives two rows. A null text gives null,
    an empty one no ids."""
    return pieces.encode(docs, pieces.Vocabulary.load(tokenizer_path()))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece_encode", sentencepiece_encode),
]

#: SQL can't express the classifier, fingerprints and bands of minima, the mix's draws or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's rows written and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
