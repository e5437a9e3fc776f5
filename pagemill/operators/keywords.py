"""Keyword lists of any length over articles (C12, C13): one pass over a text for all keywords.

``text.match_category`` and ``text.auto_tags`` look each keyword up by itself, which suits the
short lists of a rule. Here the keywords of all lists stand in automata (Aho-Corasick), and a text
is read once however many there are. Only a row's list number and its lower-cased text go to the
Python workers, in Arrow batches; all other columns stay in the JVM.

Automata are bounded: keywords are taken in blocks of at most ``BLOCK_CHARS`` characters, in order,
each of which is broadcast by itself; with more than one block a text is read once per block.

Defined cases: an empty or null keyword is no keyword; a null text or list, or a list without
keywords, has no hits; keywords given twice hit twice, each at its position; hits are in order of
position. Case is that of Spark's ``lower``, on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_CHARS = 1 << 20       # some 100 MB of automaton at the most
HIT = "struct<pos:int,keyword:string,value:bigint>"
_HIT = pa.list_(pa.struct([("pos", pa.int32()), ("keyword", pa.string()), ("value", pa.int64())]))


class Keywords:
    """Keywords of a block; the automaton is built once in each worker process."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows        # (list, pos, keyword, value, lower-cased keyword)
        self._found = None

    def __reduce__(self):
        return Keywords, (self.rows,)

    def automaton(self):
        """Automaton of the lower-cased keywords, each with its numbers in ``rows`` by list."""
        if self._found is None:
            places: dict[str, dict[str, list[int]]] = {}
            for i, (list_id, _, _, _, lower) in enumerate(self.rows):
                places.setdefault(lower, {}).setdefault(list_id, []).append(i)
            self._found = ahocorasick.Automaton()
            for lower, by_list in places.items():
                self._found.add_word(lower, by_list)
            self._found.make_automaton()
        return self._found

    def hits(self, list_id: str | None, text: str | None) -> list[dict]:
        if list_id is None or not text:
            return []
        found = {i for _, by_list in self.automaton().iter(text) for i in by_list.get(list_id, ())}
        rows = sorted((self.rows[i][1], i) for i in found)
        return [{"pos": pos, "keyword": self.rows[i][2], "value": self.rows[i][3]} for pos, i in rows]


def blocks(keywords: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Keywords]:
    """Blocks of a table (list_id, pos, keyword, value), one held at a time."""
    rows, size = [], 0
    kept = keywords.where(F.coalesce(F.col("keyword"), F.lit("")) != "").where("list_id IS NOT NULL").select(
        F.col("list_id").cast("string"), F.col("pos").cast("int"), "keyword", F.col("value").cast("long"), F.lower("keyword"))
    for r in kept.toLocalIterator():
        if rows and size + len(r[4]) > block_chars:
            yield Keywords(rows)
            rows, size = [], 0
        rows.append(tuple(r))
        size += len(r[4])
    if rows:
        yield Keywords(rows)


def _hits(sent):
    @F.arrow_udf(f"array<{HIT}>")
    def run(list_id: pa.Array, text: pa.Array) -> pa.Array:
        known = sent.value
        return pa.array([known.hits(a.as_py(), b.as_py()) for a, b in zip(list_id, text)], _HIT)

    return run


def keyword_hits(rows: DataFrame, text: Column, list_id: Column, keywords: DataFrame, out: str = "hits",
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``rows`` with an array ``out`` of the keywords (pos, keyword, value) of the row's list that
    occur in its text. ``keywords`` = (list_id, pos, keyword, value)."""
    sc = rows.sparkSession.sparkContext
    found = [_hits(sc.broadcast(b))(list_id.cast("string"), F.lower(text)) for b in blocks(keywords, block_chars)]
    if not found:
        return rows.withColumn(out, F.array().cast(f"array<{HIT}>"))
    return rows.withColumn(out, found[0] if len(found) == 1 else F.array_sort(F.concat(*found)))


def first_category(hits: Column) -> Column:
    """C12 on hits: the value of the first keyword whose value is above 0, else 0."""
    return F.coalesce(F.get(F.filter(hits, lambda h: h["value"] > 0), 0)["value"], F.lit(0).cast("long"))


def hit_tags(hits: Column) -> Column:
    """C13 on hits: the keywords in order of position, distinct."""
    return F.array_distinct(F.transform(hits, lambda h: h["keyword"]))
