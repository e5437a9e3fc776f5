"""pagemill: turn crawled web pages into a clean, deduplicated article table on Spark.

Layout:
  functions/  Column -> Column expressions (URLs, text, JSON, markers); pure Catalyst.
  operators/  DataFrame -> DataFrame operators (shred, selectors, extraction, cleaning,
              images, queue transitions, reports, rewrite hand-off).
  sources/    corpus and rule readers, article/queue/log sinks.
  plans/      end-to-end jobs (discover, collect, preview, dashboard) and the query registry.
  streaming/  Structured Streaming forms of the periodic jobs.
"""

from pagemill.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
