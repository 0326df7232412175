"""The numbered queries: each applies one operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, prefix_trie, repeated_spans, warc
from .chat_repair import ChatRepair
from .decontaminate import Decontamination
from .html_text import StyleTree
from .language_id import LanguageId, held_out
from .near_dedup import near_duplicates
from .packing import Packing
from .periodic_runs import PeriodicRuns, digests, planted
from .prefix_trie import PrefixTrie, rebuilt
from .repeated_spans import RepeatedSpans
from .toxicity import Toxicity
from .vector_search import VectorSearch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from two thirds of the labelled documents, scores all."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(3, 1)).withColumn("label", F.col("toxic"))
    scored = Toxicity().fit(docs, labels).score(docs, ["doc_id", held_out(3, 1).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four fifths of the documents, predicts all."""
    docs = table(spark, sf_dir, "documents")
    model = LanguageId().fit(docs.filter(~held_out(5, 0)))
    return model.predict(docs, ["doc_id", held_out(5, 0).alias("held_out")])


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, as rendered fragments in order."""
    return ChatRepair().repair(table(spark, sf_dir, "conversations"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources; a line in more than a tenth of a source's documents is boilerplate."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


SQL["op4_line_dedup"] = line_dedup.sql()


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words; the items found are given as a digest."""
    digest = lambda items: {"n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.array_join(items, ",").cast("binary"), 256)}
    return Decontamination().judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), digest).drop("fingerprint")


@query
def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    return VectorSearch().nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; hosts are those of the urls."""
    return StyleTree().extract(table(spark, sf_dir, "pages"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens."""
    return Packing().sequences(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written and read back."""
    return warc.archived(table(spark, sf_dir, "pages"))


SQL["op9_warc"] = warc.SQL


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity of 80 in 100."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, similarity=80)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 24 words and three periods; a tenth of the texts is made to repeat itself."""
    return digests(PeriodicRuns().collapse(planted(table(spark, sf_dir, "documents")), ["doc_id"]))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, which are made to share beginnings."""
    return PrefixTrie().nodes(*rebuilt(table(spark, sf_dir, "conversations")))


SQL["op12_prefix_trie"] = prefix_trie.SQL


@query
def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start twice or more in all documents."""
    cut = RepeatedSpans().cut(table(spark, sf_dir, "documents"), ["doc_id"], digest=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))


SQL["op13_suffix_array_dedup"] = repeated_spans.SQL
