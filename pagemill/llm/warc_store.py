"""Content-addressed WARC archive.

An archive is a folder with two Parquet tables:

- ``payloads``: (digest, payload), each payload once, named by the SHA-256 of its bytes;
- ``records``: one row per record with its exact header block (bytes), its position and the
  digest of its payload.

A record is its header block, then its content block, then two line ends. A ``response`` has the
payload as content; a ``revisit`` has none and names the record that it refers to. Reading joins
both tables on the digest and computes the digest of what it read again.

Of records with equal payloads of ``REVISIT_BYTES`` or more, the one with the smallest id is the
response and the others are revisits; smaller payloads are always responses. The response of a
digest is chosen by a minimum that is summed up before the shuffle, so a payload that a third of
all pages share costs one row per task; revisits carry no payload, so no join repeats it.

Defined cases: null html is an empty payload; a null url is written as ``about:blank``; a null id
is larger than any other and only the response if no row of the payload has an id; equal ids are
told apart by nothing, and each row is a record; line ends and control characters in a url are
written percent-encoded, so they cannot end a header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm.common import checkpoint_dir, cut_lineage, table

REVISIT_BYTES = 100
NO_ID = (1 << 63) - 1
# The record layout of the WARC 1.1 format: fixed values.
VERSION = "WARC/1.1"
END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(name: str, value) -> list:
    return [F.lit(f"{name}: "), value, F.lit(END)]


def _payloads(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    src = pages.select(F.col(id_col).cast("long").alias("page_id"),
                       F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")).alias("url"),
                       F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    return src.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))


def plan_records(src: DataFrame, date: str) -> DataFrame:
    """Per payload row: page_id, digest, record_type, refers_to and the exact header block."""
    order = F.coalesce("page_id", F.lit(NO_ID))
    # written, so that the join below has a shuffle of its own, whose hot digests Spark can split
    first = cut_lineage(src.filter(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest")
                        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
                        .filter("copies > 1").select("digest", "first"))
    revisit = F.col("first").isNotNull() & (order != F.col("first"))
    out = (src.drop("payload").join(first, "digest", "left")
           .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
           .withColumn("refers_to", F.when(revisit, F.nullif(F.col("first"), F.lit(NO_ID)))))
    return out.withColumn("header", F.encode(_header_text(date), "UTF-8")).drop("first")


def _record_id(page_id, digest):
    """A stable record name: ids and digests make it unique without state."""
    return F.concat(F.lit("<urn:pagemill:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), digest, F.lit(">"))


def _header_text(date: str):
    safe_url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1F\\x7F]", "%20")
    is_revisit = F.col("record_type") == "revisit"
    length = F.when(is_revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))
    parts = [F.lit(VERSION + END), *_header("WARC-Type", F.col("record_type")),
             *_header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
             *_header("WARC-Date", F.lit(date)), *_header("WARC-Target-URI", safe_url),
             *_header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))]
    refers = F.concat(*_header("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"))), *_header("WARC-Profile", F.lit(REVISIT_PROFILE)))
    parts += [F.when(is_revisit, refers).otherwise(F.lit("")), *_header("Content-Type", F.lit("text/html; charset=utf-8")),
              *_header("Content-Length", length), F.lit(END)]
    return F.concat(*parts)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the archive of ``pages`` to the folder ``path`` (replaced)."""
    src = _payloads(pages, id_col, url_col, html_col)
    plan_records(src, date).select("page_id", "digest", "header").write.mode("overwrite").parquet(f"{path}/records")
    (src.select("digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload"))
     .write.mode("overwrite").parquet(f"{path}/payloads"))


def _field(name: str):
    """Value of a named field of the header block."""
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), f"(?md)^{name}: ([^\r\n]*)\r$", 1), F.lit(""))


def _id_in(name: str):
    return F.regexp_extract(_field(name), "^<urn:pagemill:(-?[0-9]+):", 1).try_cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, record_type, refers_to, url, digest, payload (the full one, also of a
    revisit), verified (its digest, computed again, is its name) and record (the exact bytes)."""
    heads = spark.read.parquet(f"{path}/records")
    stored = spark.read.parquet(f"{path}/payloads").withColumn("verified", F.sha2("payload", 256) == F.col("digest"))
    rows = (heads.join(stored, "digest", "left")
            .withColumn("record_type", _field("WARC-Type")))
    content = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return rows.select("page_id", "record_type", _id_in("WARC-Refers-To").alias("refers_to"), _field("WARC-Target-URI").alias("url"),
                       "digest", "payload", F.coalesce("verified", F.lit(False)).alias("verified"),
                       F.concat("header", content, F.encode(F.lit(END + END), "UTF-8")).alias("record"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_archive`, without payloads: per record page_id, payload_bytes,
    payload_digest (computed from the stored bytes), record_type, refers_to. Each stored payload
    is read and digested once; its revisits join the outcome and not the bytes. A record whose
    payload is missing or does not have its name's digest fails the job."""
    heads = spark.read.parquet(f"{path}/records")
    stored = (spark.read.parquet(f"{path}/payloads")
              .select(F.col("digest").alias("name"), F.sha2("payload", 256).alias("digest"),
                      F.octet_length("payload").cast("long").alias("payload_bytes")))
    named = heads.select("header", F.regexp_extract(_field("WARC-Payload-Digest"), "^sha256:([0-9a-f]+)$", 1).alias("name"))
    length = _field("Content-Length").cast("long")
    kind = _field("WARC-Type")
    sound = (F.col("digest") == F.col("name")) & ((kind == "revisit") | (length == F.col("payload_bytes")))
    checked = F.when(sound, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "name")))
    return named.join(stored, "name", "left").select(
        _id_in("WARC-Record-ID").alias("page_id"), "payload_bytes", checked.alias("payload_digest"),
        kind.alias("record_type"), _id_in("WARC-Refers-To").alias("refers_to"))


_RUNS = iter(range(1 << 62))


def query(spark, sf_dir: str) -> DataFrame:
    """Archive every page in a folder of its own under the shared checkpoint folder, then read it back."""
    pages = table(spark, sf_dir, "pages")
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{spark.sparkContext.applicationId}-{next(_RUNS)}"
    write_archive(pages, path)
    return read_digests(spark, path)


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
