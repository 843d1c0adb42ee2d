"""The corpus pipeline: STAGES in order, each an operator of meterlake.llm over all that its predecessor kept."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.llm import bpe, mixing, ngram_join, quality, scratch, substrings

#: Words of a shingle, and percent of shared ones from which two documents are near duplicates.
SHINGLE_WORDS, PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; documents that it rejects go."""
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("keep").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the least doc_id. Rows of one id are one
    document, of which the row with the least text stays; rows without an id all stay."""
    found = ngram_join.similar_documents(docs, SHINGLE_WORDS, PERCENT)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns)
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    place = "place_" + max(docs.columns, key=len)  # a name that no column has
    named = named.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier document has; n_chars set anew."""
    left = substrings.remove_repeats(docs, substrings.LINE_WORDS)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources; a document occurs once for each epoch that takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, packed as little-endian unsigned 32-bit integers, and the round trip's digest."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), "text", ranks, public_tokenizers.PATTERN)
    n = F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return both.select("doc_id", "lang", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), n, "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_duplicates),
    ("substring dedup", without_repeats),
    ("mixing sources", mixed),
    ("byte-level BPE", tokens),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
