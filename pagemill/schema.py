"""Table schemas, enums, job settings and additive schema conform."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Queue statuses, log levels, post statuses, publish modes, SEO families,
# rewrite failure policies (enumerations of the collected data model).
QUEUE_STATUSES = ["pending", "running", "success", "failed", "skipped"]
LOG_LEVELS = ["info", "success", "warning", "error"]
POST_STATUSES = ["draft", "publish", "future", "pending", "private"]
PUBLISH_MODES = ["immediate", "random_future"]
SEO_FAMILIES = ["none", "rank_math", "yoast", "aioseo"]
ON_FAILURE = ["fallback", "fail"]

_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()


def _f(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


_SLOT = T.StructType([_f("selector", _S), _f("before", _S), _f("after", _S), _f("json_path", _S)])
_LINK_SLOT = T.StructType(list(_SLOT.fields) + [_f("json_url_field", _S)])
_CLEAN = T.StructType([
    _f("remove_selectors", T.ArrayType(_S)), _f("unwrap_links", _B),
    _f("drop_keywords", T.ArrayType(_S)), _f("drop_empty", _B),
])
_PAIR = T.StructType([_f("from", _S), _f("to", _S)])
_CAT = T.StructType([_f("keyword", _S), _f("category_id", _L)])

RULES = T.StructType([
    _f("rule_id", _L, False), _f("name", _S), _f("enabled", _B),
    _f("list_urls", T.ArrayType(_S)), _f("manual_urls", T.ArrayType(_S)),
    _f("pagination_pattern", _S), _f("page_start", _I), _f("page_end", _I),
    _f("link", _LINK_SLOT), _f("json_source", _S),
    _f("title", _SLOT), _f("content", _SLOT), _f("date", _SLOT),
    _f("clean", _CLEAN), _f("replacements", T.ArrayType(_PAIR)), _f("category_rules", T.ArrayType(_CAT)),
    _f("auto_tags", _B), _f("auto_tag_keywords", T.ArrayType(_S)), _f("fixed_tags", T.ArrayType(_S)),
    _f("category_id", _L), _f("author_id", _L), _f("post_status", _S), _f("publish_mode", _S),
    _f("publish_delay_min", _I), _f("publish_delay_max", _I), _f("batch_limit", _I), _f("retry_limit", _I),
    _f("request_delay", _I), _f("dedupe_title", _B), _f("auto_excerpt", _B), _f("excerpt_length", _I),
    _f("seo_family", _S), _f("seo_title_template", _S), _f("seo_desc_template", _S),
    _f("localize_images", _B), _f("set_featured", _B), _f("image_alt_template", _S),
    _f("rewrite", _B), _f("rewrite_prompt", _S), _f("rewrite_on_failure", _S),
    _f("created_at", _TS), _f("updated_at", _TS), _f("last_discovered_at", _TS), _f("last_collected_at", _TS),
])

QUEUE = T.StructType([
    _f("queue_id", _L, False), _f("rule_id", _L), _f("url", _S), _f("url_hash", _S), _f("status", _S),
    _f("attempts", _I), _f("last_error", _S), _f("article_id", _L),
    _f("discovered_at", _TS), _f("scheduled_at", _TS), _f("started_at", _TS), _f("finished_at", _TS),
])

LOGS = T.StructType([
    _f("log_id", _L, False), _f("rule_id", _L), _f("queue_id", _L), _f("level", _S), _f("message", _S),
    _f("url", _S), _f("created_at", _TS),
])

ARTICLES = T.StructType([
    _f("article_id", _L, False), _f("title", _S), _f("content", _S), _f("excerpt", _S), _f("status", _S),
    _f("published_at", _TS), _f("author_id", _L), _f("category_ids", T.ArrayType(_L)),
    _f("tags", T.ArrayType(_S)), _f("source_url", _S), _f("seo", T.MapType(_S, _S)), _f("featured_image", _S),
])

# Defaults of a rule for every column a stored or imported rule may lack (fixed values).
RULE_DEFAULTS: dict[str, object] = {
    "name": "", "enabled": True, "list_urls": [], "manual_urls": [], "pagination_pattern": "",
    "page_start": 1, "page_end": 1, "json_source": "__NEXT_DATA__",
    "title": {"selector": "//h1", "before": "", "after": "", "json_path": ""},
    "content": {"selector": "//article", "before": "", "after": "", "json_path": ""},
    "date": {"selector": "", "before": "", "after": "", "json_path": ""},
    "link": {"selector": "", "before": "", "after": "", "json_path": "", "json_url_field": ""},
    "clean": {"remove_selectors": [], "unwrap_links": False, "drop_keywords": [], "drop_empty": True},
    "replacements": [], "category_rules": [], "auto_tags": False, "auto_tag_keywords": [], "fixed_tags": [],
    "category_id": 0, "author_id": 0, "post_status": "draft", "publish_mode": "immediate",
    "publish_delay_min": 0, "publish_delay_max": 0, "batch_limit": 5, "retry_limit": 3, "request_delay": 1,
    "dedupe_title": True, "auto_excerpt": True, "excerpt_length": 160, "seo_family": "none",
    "seo_title_template": "", "seo_desc_template": "", "localize_images": False, "set_featured": False,
    "image_alt_template": "", "rewrite": False, "rewrite_prompt": "", "rewrite_on_failure": "fallback",
}


@dataclass(frozen=True)
class Settings:
    """Global job settings (folded into plans as literals). Ranges are the clamps applied."""

    global_collect_limit: int = 10      # 1..100, then capped at 50 per batch
    running_timeout_minutes: int = 30   # 5..1440
    max_rules_per_discover: int = 20    # 1..100
    log_retention: int = 2000           # 100..20000
    enable_logs: bool = True
    max_images_per_post: int = 10       # 0..50
    max_image_size_mb: int = 5          # 1..50
    rewrite_temperature: float = 0.7    # 0..2
    rewrite_max_input_chars: int = 12000  # 1000..60000
    rewrite_prompt: str = ""
    rewrite_model: str = ""
    site_name: str = ""
    drop_port: bool = False
    extra: dict = field(default_factory=dict)


def as_of_lit(as_of: _dt.datetime | str) -> Column:
    """A fixed clock as a TIMESTAMP_NTZ literal (jobs never read the wall clock)."""
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    return F.lit(as_of).cast("timestamp_ntz")


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """S10 additive schema conform: add every column of ``schema`` missing from ``df``
    (typed null, or the declared default), cast present ones, and order as ``schema``.

    Extra columns of ``df`` are dropped — the schema is the contract.
    """
    defaults = defaults or {}
    have = {f.name.lower(): f.name for f in df.schema.fields}
    cols = []
    for fld in schema.fields:
        src = have.get(fld.name.lower())
        base = F.col(f"`{src}`").cast(fld.dataType) if src else F.lit(None).cast(fld.dataType)
        if fld.name in defaults and not isinstance(fld.dataType, (T.StructType, T.ArrayType, T.MapType)):
            base = F.coalesce(base, F.lit(defaults[fld.name]).cast(fld.dataType))
        cols.append(base.alias(fld.name))
    return df.select(*cols)
