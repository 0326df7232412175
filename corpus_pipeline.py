"""Corpus preparation for training: language identification, line dedup, near-duplicate removal, benchmark
decontamination and packing. Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all
but the last return the columns of documents, whatever these are besides doc_id, text, lang, source and n_chars.

Defined results: documents with null, empty or letterless text have no language and go with the first stage, and if no
document has a language all do; a null source is a source of its own; rows that repeat doc_id and text are one document
after near dedup, rows of one doc_id with other texts stay or go together; rows without doc_id stay, each on its own; a text
of any length is read whole; an empty table gives an empty result, and an empty benchmark contaminates nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasktide.llm.decontaminate import drop_contaminated
from tasktide.llm.language_id import LanguageId, keep_identified
from tasktide.llm.line_dedup import drop_boilerplate
from tasktide.llm.near_dedup import drop_near_duplicates
from tasktide.llm.packing import Packing
from tasktide.llm.tables import Workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can't tell go."""
    return keep_identified(docs, LanguageId().fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source leave its texts; no document goes. n_chars follows the text. Copies are still there
    and count once, or all copies of a text would be emptied before near dedup can keep one."""
    out = drop_boilerplate(docs, counts=("__lines", "__dropped"), once=True)
    return out.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, similarity of 80 in 100)."""
    return drop_near_duplicates(docs, shingle=5, similarity=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are words of benchmark windows go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, placed in sequences of 4096 tokens."""
    return Packing().sequences(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: No SQL has connected components of near copies, or packing: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again by the next."""
    work, docs, before = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            work.drop(before)  # no later stage reads it
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
