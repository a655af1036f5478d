"""The corpus pipeline: five stages from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgrid.llm import exact, gam, mixing, packing, simhash
from kelpgrid.llm.common import whole
from kelpgrid.llm.encoding import word_bpe
from kelpgrid.llm.queries import TARGETS, domain_of, table, vocabulary_file
from kelpgrid.session import materialize


READ = ("doc_id", "text", "lang", "source")  # columns that stages look at


def keeping(stage):
    """``stage`` over the columns that it reads; all others go along in one, so their names cannot clash with its own."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [F.col(f"`{c}`") for c in docs.columns if c not in READ]
        out = stage(spark, docs.select(*READ, F.struct(F.lit(0).alias("carried"), *others).alias("carried")), sf_dir)
        return out.select(*[F.col(c) if c in READ else F.col(f"carried.`{c}`") for c in docs.columns])

    run.__doc__ = stage.__doc__
    return run


@keeping
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the classifier's cut."""
    model = gam.fit(docs, table(spark, sf_dir, "labels"))
    return gam.with_score(docs, model).filter(F.col("score") >= gam.CUT)


@keeping
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact.kept_documents(docs)


@keeping
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one that names it."""
    return simhash.representatives(docs)


@keeping
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mixture; a document used in two epochs appears twice, rows that repeat id and text count as one."""
    uses = mixing.mix(docs, TARGETS, domain_of(F.col("source"))).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).cast("int").alias("__uses"))
    keyed = docs.withColumn("__key", F.xxhash64(whole(F.col("text"))))
    rows = keyed.groupBy("doc_id", "__key").agg(F.count(F.lit(1)).alias("__n"))
    uses = uses.join(rows.withColumnRenamed("doc_id", "__row"), F.col("doc_id").eqNullSafe(F.col("__row")) & (F.col("text_hash") == F.col("__key")))
    uses = materialize(uses.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__uses", "__n"))
    found = keyed.join(uses, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")))
    found = found.filter("__n = 1").unionByName(found.filter("__n > 1").dropDuplicates(["__id", "__hash"]))
    return found.withColumn("__use", F.explode(F.array_repeat(F.lit(1), F.col("__uses"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token stream in sequences of 2048."""
    return packing.pack(docs, word_bpe(vocabulary_file("word_bpe_49k.json")))


STAGES = [("quality classifier", classify), ("exact dedup", dedup), ("simhash near-dedup", near_dedup), ("mixing", mix), ("packing", pack)]

# No stage but the second can be written in SQL (a trained model, 64-bit hashes, tokenizers); the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
