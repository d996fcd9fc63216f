"""A corpus pipeline of five stages, each written and read again before the next.

Every stage takes the columns of documents and keeps all rows that it does not
decide against; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import line_dedup, mixing, near_copies as near, pieces, quality
from tallyloom.llm.base import packed, rest_of, same, saved, table, unpacked


#: What the stages read by name; all other columns travel packed and come back as they were.
KEY = ("doc_id", "text")


#: Bytes of texts that a task hands to its worker at once; both hold them several times over.
BATCH_BYTES = 8 << 20


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a quality score under its threshold go."""
    _small_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels)
    scored = quality.score(packed(docs, *KEY), model)
    return unpacked(scored.filter(F.col("score") >= quality.THRESHOLD), docs, *KEY)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters and more in three documents and more stay in the last of them only."""
    _small_batches(spark)
    kept = line_dedup.line_dedup(packed(docs, *KEY))
    n_chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return unpacked(kept, docs, *KEY, **n_chars)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id stays.

    A group leaves one row. Where its smallest doc_id has several texts, one of them
    stays. Documents that share a doc_id, or have none, but are no copies all stay;
    a document without a doc_id stays only in a group without any.
    """
    _small_batches(spark)
    found = near.near_copies(docs.select("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))).alias("first")
    stay = found.groupBy("root").agg(first).select("first._id", "first._key")
    keyed = packed(docs, *KEY).withColumn("_text_key", near.text_key(F.col("text").cast("string")))
    kept = keyed.join(stay, same(F.col("doc_id"), F.col("_id")) & same(F.col("_text_key"), F.col("_key")), "left_semi")
    return unpacked(kept.dropDuplicates(["doc_id", "_text_key"]), docs, *KEY)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, whole or by a seeded draw, so that each source comes to its target."""
    return mixing.repeated(docs)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, and whether they decode to its text.

    ids, n_pieces and exact take the place of the text; where documents have a column
    of such a name, the stage's gets an underscore at its end.
    """
    _small_batches(spark)
    coded = pieces.encode(packed(docs, *KEY))
    own = {"ids": F.col("ids"), "n_pieces": F.size("ids").cast("long"), "exact": F.col("exact")}
    return coded.select("doc_id", *rest_of(docs, *KEY), *[c.alias(_free(name, docs.columns)) for name, c in own.items()])


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_copies),
    ("mixing sources", source_mix),
    ("SentencePiece encoding", encoded),
]

#: The classifier, the fingerprints' components and the pieces have no SQL; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{i}")
    return docs
