"""Rule import/export (S3, S4), manual URL source (S5) and rule validation (V6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pagemill.functions.text import sanitize_json_source
from pagemill.functions.urls import parse_urls
from pagemill.operators.joins import rank_in_group
from pagemill.session import path_bytes

MAX_IMPORT_BYTES = 2 * 1024 * 1024
MAX_IMPORT_RULES = 200
# Columns dropped on export (identity and timestamps).
EXPORT_DROP = ["rule_id", "created_at", "updated_at", "last_discovered_at", "last_collected_at"]

# Allowed enumerations used by validation.
FORM_POST_STATUSES = ["draft", "publish", "future", "pending"]
PUBLISH_MODES = ["immediate", "random_future"]
SEO_FAMILIES = ["none", "rank_math", "yoast", "aioseo"]
ON_FAILURE = ["fallback", "fail"]


def _absint(c: Column) -> Column:
    """|int(x)|; non-numeric -> 0."""
    return F.abs(F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0)).cast("long")).cast("int")


def _clamp(c: Column, lo: int, hi: int | None = None) -> Column:
    v = F.greatest(F.lit(lo), _absint(c))
    return F.least(v, F.lit(hi)) if hi is not None else v


def _enum(c: Column, allowed: list[str], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def validate_rules(rules: DataFrame) -> DataFrame:
    """V6: clamp and repair rule settings; ``violations`` lists the repaired fields."""
    start = _clamp(F.col("page_start"), 1)
    end = F.greatest(_clamp(F.col("page_end"), 1), start)
    dmin = _absint(F.col("publish_delay_min"))
    dmax = F.greatest(_absint(F.col("publish_delay_max")), dmin)
    fixed = {
        "batch_limit": _clamp(F.col("batch_limit"), 1, 50),
        "retry_limit": F.least(_absint(F.col("retry_limit")), F.lit(10)),
        "request_delay": F.least(_absint(F.col("request_delay")), F.lit(30)),
        "page_start": start, "page_end": end,
        "publish_delay_min": dmin, "publish_delay_max": dmax,
        "excerpt_length": _clamp(F.col("excerpt_length"), 50, 500),
        "post_status": _enum(F.col("post_status"), FORM_POST_STATUSES, "draft"),
        "publish_mode": _enum(F.col("publish_mode"), PUBLISH_MODES, "immediate"),
        "seo_family": _enum(F.col("seo_family"), SEO_FAMILIES, "none"),
        "rewrite_on_failure": _enum(F.col("rewrite_on_failure"), ON_FAILURE, "fallback"),
        "json_source": sanitize_json_source(F.col("json_source")),
    }
    changed = [F.when(~F.col(k).cast("string").eqNullSafe(v.cast("string")), F.lit(k)) for k, v in fixed.items()]
    out = rules.select("rule_id", *[v.alias(k) for k, v in fixed.items()],
                       F.array_compact(F.array(*changed)).alias("violations"))
    return out


def export_rules(rules: DataFrame, path: str) -> None:
    """All rules without id and timestamps as JSON lines, one rule per line, in rule-id order:
    range-partitioned, so no task gathers the whole table, and the order is that of file names and
    lines. ``import_rules`` reads this form as well as ``{"version", "rules": [...]}`` documents."""
    body = rules.repartitionByRange("rule_id").sortWithinPartitions("rule_id")
    body.drop(*[c for c in {*EXPORT_DROP, "rule_id"} if c in rules.columns]).write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: (pos, r, reason) of the rules of an import, in file, line and list order from 0. ``r``
    has the keys of ``schema``; ``reason`` says why a rule cannot be used, or is null: a line that is
    no JSON object, a rule that is none, a value that does not fit its key's type."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_line"), F.col("value"))
    lines = lines.where(F.trim("value") != "")
    listed = F.from_json("value", "rules array<variant>")["rules"]
    one = F.array(F.col("value"))
    raw = lines.select("_file", "_at", "_line", F.posexplode(F.when(listed.isNotNull(), F.transform(listed, lambda x: F.to_json(x))).otherwise(one)).alias("_item", "_raw"))
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    r = F.from_json("_raw", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = raw.withColumn("r", r)
    reason = F.when(~F.coalesce(F.col("_raw").rlike(r"^\s*\{"), F.lit(False)), "not an object") \
        .when(F.try_parse_json("_raw").isNull(), "not valid JSON").when(F.col("r._bad").isNotNull(), "a value does not fit its key")
    order = ["_file", "_at", "_line", "_item"]
    ranked = rank_in_group(parsed.withColumn("reason", reason).withColumn("_g", F.lit(0)), ["_g"], order, "pos")
    return ranked.select((F.col("pos") - 1).alias("pos"), F.struct(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]).alias("r"),
                         "reason", F.col("_raw").alias("raw"))


def refused_rules(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: (pos, reason, raw) of the rules that an import leaves out."""
    return read_rules(spark, path, schema).where(F.col("reason").isNotNull()).select("pos", "reason", "raw")


def import_rules(spark: SparkSession, path: str, defaults: dict, schema: T.StructType, max_bytes: int | None = None,
                 max_rules: int | None = None) -> DataFrame:
    """S3: rules from JSON lines (``export_rules``) or ``{version, rules:[...]}`` documents (one a
    line); only known keys (``schema``), missing ones from ``defaults``. Validate with V6. Rules that
    cannot be read are left out, and ``refused_rules`` lists them; the others are numbered in order.
    ``max_bytes`` refuses a larger import and ``max_rules`` keeps the first rules in export
    order; both are unbounded unless given (an upload form would pass MAX_IMPORT_BYTES and
    MAX_IMPORT_RULES)."""
    if max_bytes is not None and path_bytes(spark, path) > max_bytes:
        raise ValueError(f"rule import larger than {max_bytes} bytes")
    rows = read_rules(spark, path, schema)
    if max_rules is not None:
        rows = rows.where(F.col("pos") < max_rules)
    rows = rank_in_group(rows.where(F.col("reason").isNull()).withColumn("_g", F.lit(0)), ["_g"], ["pos"], "rule_id")
    cols = []
    for fld in schema.fields:
        c = F.col("r." + fld.name)
        if fld.name in defaults:
            c = F.coalesce(c, F.lit(defaults[fld.name]).cast(fld.dataType))
        cols.append(c.alias(fld.name))
    return rows.select(F.col("rule_id").cast("long").alias("rule_id"), *cols)


def manual_urls(rules: DataFrame, text_col: str = "manual_urls_text") -> DataFrame:
    """The manual URL block of each rule as rows (rule_id, pos, url): one URL per line,
    normalised, safe, de-duplicated in order."""
    return rules.select("rule_id", F.posexplode(parse_urls(F.col(text_col))).alias("pos", "url"))
