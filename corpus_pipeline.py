"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept, and returns a DataFrame that is written as Parquet and reread. All but the
last return the columns of ``documents``.

Defined results: a row is judged by its id and text, so rows with a null id, and other texts under one id, are judged for
themselves. A null or empty text is not toxic, loses no lines, counts as a copy of other such texts, has size 0 and is
never drawn. A row with a null id keeps its lines. Of rows that repeat id and text one stays; of a group of similar texts the
row with the least id, one with an id before one without. Columns beyond those of ``documents`` stay up to the mix; ``n_chars``,
if there, follows the text. An empty table, or one that a stage empties, ends in no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import line_dedup, mixing, packing, simhash, toxicity
from framelake.llm.common import broadcast_if_small
from framelake.llm.queries import vocabulary
from framelake.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score_documents(docs, labels)
    bad = materialise(found.where("predicted = 1").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "toxic")
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (toxicity.text_hash(F.col("text")) == F.col("bad_hash"))
    return docs.join(broadcast_if_small(bad), same, "left_anti")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand elsewhere before go; every document stays, with what is left of it."""
    found = line_dedup.dedup_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document with the least id stays, one with an id before one without.

    A document is its id and text together: other texts under its id are judged for
    themselves, and a row without an id by its text. Rows that repeat both are one document.
    """
    keyed = docs.select("*", F.xxhash64(F.col("doc_id").isNull(), "doc_id", toxicity.text_hash(F.col("text"))).alias("near_key"))
    found = materialise(simhash.similar_groups(keyed, key="near_key"), "groups")
    rows = found.groupBy("near_key").agg(F.min("component_id").alias("component_id"), F.count("*").alias("times"))
    ids = keyed.groupBy(F.col("near_key").alias("k")).agg(F.min("doc_id").alias("id"))
    rows = materialise(rows.join(ids, F.col("near_key") == F.col("k")).drop("k"), "keyed")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "near_key")).alias("best")
    best = rows.groupBy("component_id").agg(best).select(F.col("best.near_key").alias("near_key"))
    others = materialise(rows.join(best, "near_key", "left_anti").select("near_key"), "others")
    kept = keyed.join(broadcast_if_small(others), "near_key", "left_anti")
    repeated = materialise(rows.where("times > 1").select("near_key"), "repeated")
    if repeated.limit(1).count():
        repeated = broadcast_if_small(repeated)
        once = kept.join(repeated, "near_key", "left_semi").dropDuplicates(["near_key"])
        kept = kept.join(repeated, "near_key", "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a row comes as often as it is drawn."""
    return mixing.drawn_rows(mixing.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned scores, hashes and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written in the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
