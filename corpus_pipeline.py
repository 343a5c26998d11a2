"""Documents to training tokens: five stages, each reading what the one before it kept.

Every function takes (spark, docs, sf_dir), where docs has the columns of
documents (doc_id, text, lang, source, n_chars). All but the last return these
columns; their decisions are final: rows go, or their text is changed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import catalog
from cuemill.llm.decontaminate import find_contamination
from cuemill.llm.jaccard_join import jaccard_components
from cuemill.llm.secrets import redact_secrets
from cuemill.llm.toxicity import learn_toxicity, score_toxicity
from cuemill.session import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _transcripts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("media_id"), *[c for c in COLUMNS if c != "doc_id"])


def _documents(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("media_id", "doc_id").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject, the model being learned from labelled ones among ``docs``."""
    marks = catalog.training_marks(spark, sf_dir, "toxic")
    rows = _transcripts(docs)
    model = learn_toxicity(rows.select("media_id", "text").join(marks, "media_id"))
    found = score_toxicity(rows, model, keep=("media_id", *COLUMNS[1:]))
    return _documents(found.filter("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents that links hold together, the one of smallest id (null last); repeated rows of it once.

    A document is an id and a text: different texts under one id, or under none,
    are documents of their own. Rows without a word are no copies and all stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"))
    rows = docs.withColumn("key", key)
    found = jaccard_components(rows.select(F.col("key").alias("media_id"), "text"))
    first = found.filter("media_id = component_id").select(F.col("media_id").alias("key"), "n_shingles").distinct()
    each = F.when(F.col("n_shingles") == 0, F.monotonically_increasing_id())
    return rows.join(first, "key").withColumn("each", each).dropDuplicates(["key", "each"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark text stands; what is found in a text holds for all rows with it."""
    key = F.md5("text")
    found = find_contamination(docs.select(key.alias("media_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = found.filter("n_hit > 0").select(F.col("media_id").alias("key"))
    return docs.withColumn("key", key).join(hit, "key", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by its kind, and their lengths counted anew."""
    found = redact_secrets(_transcripts(docs), keep=("media_id", *COLUMNS[1:]))
    return _documents(found.withColumn("n_chars", F.length("text").cast("long")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the digests of the ids and of the text decoded from them."""
    return catalog.encoded(_transcripts(docs)).select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]

# Toxicity is a learned model, which SQL cannot state: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
