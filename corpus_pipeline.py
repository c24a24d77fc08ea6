"""The corpus pipeline: raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscan.llm import langid, minhash, mixing, packing, suffixes
from emberscan.llm.store import written
from emberscan.session import shuffle_partitions

#: Texts whose nearest language is not at least so near are in none of the learned languages.
LEAST_COSINE = 0.03

TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages. Without letters, or near to none of them, they go."""
    learned = langid.prototypes(docs.where(~langid.is_held_out()))
    rows = docs.select(_row(docs), F.col("text"))
    judged = langid.predict(rows, learned, ("row",))
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_COSINE)).select("row.*")


def _row(docs: DataFrame) -> Column:
    """The whole row as one value: whatever its columns are called, none clashes with what a stage adds."""
    return F.struct(*docs.columns).alias("row")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least, those without an id last.

    Rows with equal id and text are one document, rows that share only the id are different ones. Documents are numbered in
    the order of their ids and then of a digest, and the operator gets the numbers, so a row without an id is judged by its
    text like any other.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key = F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.when(text.isNull(), ":").otherwise(F.concat(F.lit("="), text))), 256))
    named = written(docs.groupBy(key.alias("key")).agg(F.min(doc_id).alias("id"), F.count("*").alias("rows")), "named")
    order = [F.col("id").asc_nulls_last(), F.col("key")]
    numbered = named.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    numbered = written(numbered.select("key", F.monotonically_increasing_id().alias("number")), "numbered")
    texts = docs.select(key.alias("key"), text.alias("text")).join(numbered, "key").select(F.col("number").alias("doc_id"), "text")
    kept = minhash.near_duplicates(texts).where("kept").select(F.col("doc_id").alias("number")).distinct()
    kept = written(numbered.join(kept, "number", "left_semi").select("key"), "kept")
    rows = docs.select(_row(docs), key.alias("key")).join(kept, "key", "left_semi")
    return (rows if named.where("rows > 1").isEmpty() else rows.dropDuplicates(["key"])).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a document with a smaller id has; documents of which nothing is left go.

    A row without an id neither loses bytes nor takes any, a NULL text stays NULL, and `n_chars` follows a changed text.
    """
    judged = suffixes.repeated_bytes(docs, with_text=True).where("n_removed > 0")
    cut = judged.select(F.col("doc_id").alias("id"), "text_id", F.col("kept_text").alias("left")).dropDuplicates(["id", "text_id"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("text_id"))
    rows = rows.join(cut, ["id", "text_id"], "left").where("left is null or left != ''")
    changed = {"text": F.coalesce("left", "row.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("left").isNull(), F.col("row.n_chars")).otherwise(F.length("left"))
    return rows.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its rate says, so that the labelled domains reach their weights in expectation.

    Rows without an id or text and repeated rows have rates and coins of their own; a rate below one may leave a row out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = mixing.mix(docs.select(_row(docs), "doc_id", "text"), labels, keep=("row",), tokenizer=TOKENIZER)
    return rated.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences; a NULL text is its end token alone, and every row is packed."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("target_weights", target_weights),
    ("sequences", sequences),
]

#: No SQL says hyperdimensional profiles, a fitted classifier or a genetic algorithm; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
