"""A training corpus out of raw documents: classify, drop repeated lines and near copies, mix sources, pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beatframe.llm.base import WORD, attach, stage
from beatframe.llm.line_dedup import remove_repeated_lines
from beatframe.llm.mixing import mix_sources
from beatframe.llm.near_dedup import near_duplicates
from beatframe.llm.packing import pack_documents
from beatframe.llm.quality_classifier import learn_quality, quality_score

KEEP = 0.5
#: Least words of a line that counts as a repeat by itself.
ALONE = 10
#: Link tables of near copies up to this many rows are contracted in one task (about 100 MB); larger ones by rounds of joins.
ONE_TASK = 500_000
#: Up to this many texts that go as near copies are broadcast (ids and hashes); more are joined by key, which shuffles all texts.
FEW = 1_000_000


def with_text(row: Column, names: list[str]) -> Column:
    """The row with n_chars counted anew, where it has that column."""
    return row.withField("n_chars", F.length(row["text"]).cast("bigint")) if "n_chars" in names else row


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``KEEP``; null and empty texts go."""
    params = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(F.coalesce(F.rlike("text", F.lit(WORD)), F.lit(False)) & (quality_score(F.col("text"), params) >= KEEP))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs and the lines of ``ALONE`` words or more that stand earlier; those that lose every line go."""
    r = remove_repeated_lines(docs, alone=ALONE).where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_removed") == 0))
    return r.select(F.when(F.col("n_removed") == 0, F.col("row")).otherwise(with_text(F.col("row"), docs.columns)).alias("row")).select("row.*")


def shortened_copies(docs: DataFrame, originals: DataFrame) -> DataFrame:
    """Id and text hash of documents that line dedup shortened and whose whole text was a near copy of that of another document still there.

    What such a document keeps are the lines that its copy has changed: a fragment that resembles nothing. Only ids, hashes and lengths are joined.
    Null ids and ids with several texts are left out, as their whole text isn't known.
    """
    near = near_duplicates(originals, shingle=5, percent=80, one_task=ONE_TASK).where("label IS NOT NULL").select("label", F.col("doc_id").alias("o_id"), F.col("text_hash").alias("o_hash"))
    texts = originals.groupBy(F.col("doc_id").alias("s_id")).agg(F.min(F.xxhash64("text")).alias("s_hash"), F.max(F.xxhash64("text")).alias("s_last"), F.max(F.length("text")).alias("s_size"))
    size = texts.where("s_hash = s_last").drop("s_last")
    here = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").alias("size"))
    known = near.join(size, (F.col("o_id") == F.col("s_id")) & (F.col("o_hash") == F.col("s_hash")))
    there = stage(known.join(here, F.col("doc_id") == F.col("o_id")), "there")
    first = there.groupBy("label").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    mates = attach(there.select("label", "doc_id", "text_hash", "size", "o_hash", "s_size"), first, ["label"], F.xxhash64("doc_id", "text_hash"), there.count(), 1000)
    cut = (F.col("text_hash") != F.col("o_hash")) & (F.col("size") < F.col("s_size"))
    return mates.where(cut & (F.col("doc_id") > F.col("first"))).select("doc_id", "text_hash").distinct()


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): of its smallest id, the text with the least hash.

    Documents that line dedup cut down and that were near copies of another one before that go too: they are told by the whole texts in ``sf_dir``.
    """
    same_text = ["doc_id", "text_hash"]
    near = near_duplicates(docs, shingle=5, percent=80, one_task=ONE_TASK)
    gone = shortened_copies(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    every = stage(near.groupBy("label", *same_text).agg(F.count(F.lit(1)).alias("rows")), "every")
    texts = every.join(gone, same_text, "left_anti")
    alone = F.when(F.col("label").isNull(), F.struct("doc_id", "text_hash"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "rows"))
    kept = texts.groupBy("label", alone.alias("alone")).agg(first.alias("first")).select("first.k_id", "first.k_hash", "first.rows")
    kept = stage(kept, "kept")
    copy = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))
    dropped = stage(every.join(kept, copy, "left_anti").select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash")), "dropped")
    same = F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.xxhash64("text") == F.col("d_hash"))
    out = docs.join(F.broadcast(dropped) if dropped.count() <= FEW else dropped, same, "left_anti")
    if not kept.where("rows > 1").isEmpty():  # repeated rows of one id and text
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_sources(docs).select(F.col("row"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of several lengths."""
    return pack_documents(docs)


STAGES = [("quality classifier", classify), ("line dedup", drop_lines), ("MinHash near-dedup", drop_near), ("mixing sources to target weights", mix),
          ("best-fit packing", pack)]

#: A trained network and the subset-sum fit cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
