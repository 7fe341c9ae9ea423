"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm import langid, minhash, mixing, packing, substrings
from pulsegrid.llm.base import STORED, delete, discard, materialize, shielded, small

#: Language ID rejects a text without letters, and one whose best language is less likely than this.
LEAST_SCORE = 0.4


#: Runs of three sentences with fewer words go on: unrelated texts share runs of one-word sentences by chance.
LEAST_WORDS = 8
#: Rows in an Arrow batch at most. With Spark's 10,000 a batch of texts takes tens of MB, in the JVM's native memory, which the C library keeps, and again in the worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Folders that the last stage's result reads.
_LEFT: set[str] = set()

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """A stage that first deletes what the one before kept for its result: that is written by now. Folders that docs itself reads stay.

    Sets the session's Arrow batches to BATCH_ROWS rows if they are longer; it stays so, as the caller runs the result.
    """

    @wraps(work)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
            spark.conf.set(_BATCH, BATCH_ROWS)
        read = {part for file in docs.inputFiles() for part in file.split("/")}
        for path in [p for p in _LEFT if p.rpartition("/")[2] not in read]:
            delete(spark, path)
            _LEFT.discard(path)
        before = set(STORED)
        made = work(spark, docs, sf_dir)
        _LEFT.update(STORED - before)
        return made

    return staged


@stage
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learns from the documents table itself, as op10 does."""
    df, back = shielded(docs, ["doc_id", "text", "lang"])
    return back(langid.identify(df).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score"))


@stage
def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null last), of each group of near duplicates on five-word shingles.

    A row is named by a 64-bit hash of its id and text, so that rows without an id or with a shared one are judged each by its own text;
    of rows equal in both one stays. Texts stay where they are while the rows kept are few (small()).
    """
    df, back = shielded(docs, ["doc_id", "text"])
    df = df.withColumn("_row", F.xxhash64(F.lit(7), "doc_id", "text"))
    groups = minhash.near_duplicates(df.select("doc_id", "_row", "text"), key="_row", width=5)
    groups = materialize(groups.select("doc_id", "_row", "component_id"), "named")
    name = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = groups.groupBy("component_id").agg(F.min(name).alias("name")).select("name._row")
    copies = groups.groupBy("_row").agg(F.count("*").alias("_n"))
    first = materialize(first.join(copies, "_row"), "first")
    discard(groups)
    held = df.join(small(first), "_row")
    equal = held.where("_n > 1").withColumn("_at", F.row_number().over(Window.partitionBy("_row").orderBy("_row"))).where("_at = 1").drop("_at")
    return back(held.where("_n = 1").unionByName(equal).drop("_n", "_row"))


@stage
def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated spans; a document of which nothing is left goes. n_chars, if there, is that of the new text."""
    df, back = shielded(docs, ["doc_id", "text"])
    made = back(substrings.remove_repeated_spans(df, least_words=LEAST_WORDS).where(F.col("text").rlike(r"\S")).drop("n_sentences", "n_removed"))
    return made.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents whole, once, twice or not at all."""
    return mixing.mixed_documents(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    return packing.pack_documents(docs.select("doc_id", "source", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identified),
    ("MinHash near-dedup", deduplicated),
    ("substring dedup", cleaned),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages rest on trained models, min-hashes and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for at, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs, "stage")
            if written:
                discard(written)
            written = docs
    return docs
