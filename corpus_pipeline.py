"""The training-data pipeline: quality rules, line dedup, near-duplicates, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``;
``n_chars`` follows the text. Defined cases: an empty input gives an empty result; rows with null
ids pass all stages by themselves; rows of one id count as one document for near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import checkpoint_dir, named
from pagemill.llm.line_dedup import dedup_lines
from pagemill.llm.near_dup import near_duplicates
from pagemill.llm.packing import pack_documents
from pagemill.llm.quality import quality
from pagemill.llm.secret_scan import redacted


def _with_text(row: str, columns: list[str], text) -> list:
    """The columns of the struct ``row`` with a new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new.get(c, F.col(row)[c]).alias(c) for c in columns]


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality(docs).filter("kept").select("doc.*")


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents hold too."""
    return dedup_lines(docs).select(*_with_text("doc", docs.columns, F.col("kept_text")))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*map(named, docs.columns))


def mask_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked."""
    masked = redacted(docs).select(F.struct(*map(named, docs.columns)).alias("doc"))
    return masked.select(*_with_text("doc", docs.columns, F.col("doc.text")))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of training sequences."""
    return pack_documents(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

# Model-based stages, components and tokenizers have no SQL; tests hold run() against brute force.
ORACLE_SQL = None

_RUNS = iter(range(1 << 62))


def run(spark, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what is between them lies in the shared folder."""
    place = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{spark.sparkContext.applicationId}-{next(_RUNS)}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{number}-{name}")
            docs = spark.read.parquet(f"{place}/{number}-{name}")
    return docs
