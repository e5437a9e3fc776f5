"""Operator 11: Order MinHash fingerprints of documents, in DataFrame functions only.

A text is read as symbols: words, cut after 16 code points, and single code points from U+2E80
to U+FFFF (scripts that write no blanks). A k-mer is a symbol with the ``k - 1`` after it (fewer
at the end of the text) as they stand in the text, blanks included; it carries its occurrence
number, so the fifth repetition of a phrase is another element than the first. Every numbered
k-mer is hashed into one of ``tuples * size`` slots. The smallest of each slot is selected, and
the ``size`` ones of a tuple, kept in the order in which they stand in the text, are hashed to
one 58-bit value: two texts agree on a tuple if they share its minimal k-mers in equal order.

The k-mers of a document travel as rows of its own partition: numbering is a window and
selection a partial minimum per slot, both over the partitioning that brought the text there,
so k-mers are never shuffled and a very long text is sorted (and spilled) like any rows.

Likeness: equal tuples over tuples that at least one of both texts has; two texts without any
symbol are alike (1.0), one with and one without are not (0.0).

Defined cases: a null text is empty. Documents stand in descending (doc_id, hash of the text),
null ids last, the last is followed by the first; a single document is followed by itself. Rows
of equal id and text count as one document there, and each gets its row. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pagemill.llm.common import cut_lineage, n_partitions, table
from pagemill.operators.joins import rank_in_group

K, TUPLES, SIZE = 3, 32, 2
PARTS = 4
BLANK = r"[\x20\x09-\x0D]"
SYMBOL = r"(?:[^\x20\x09-\x0D⺀-￿]{1,16}|[⺀-￿])"
# Never null, so that joins, windows and groups of a document share one partitioning.
KEY = ["id", "text_hash"]


def k_mers(text, k: int = K):
    """The k-mers of a text, one for each symbol, in text order."""
    return F.regexp_extract_all(text, F.lit(f"(?=({SYMBOL}(?:{BLANK}*{SYMBOL}){{0,{k - 1}}})){SYMBOL}"), F.lit(1))


def signatures(texts: DataFrame, by: list[str], k: int = K, tuples: int = TUPLES, size: int = SIZE) -> DataFrame:
    """``by`` and ``tuples`` (sorted array of tuple number << 58 | tuple hash) of the ``text`` of
    each row with a symbol; ``by`` is unique."""
    if tuples > 32 or size > 32:
        raise ValueError("at most 32 tuples of at most 32 k-mers")
    slots = tuples * size
    rows = texts.select(*by, F.posexplode(k_mers(F.col("text"), k)).alias("pos", "k_mer")) \
        .select(*by, "pos", F.xxhash64("k_mer").alias("h"))
    # sorted by the hash first, one number that tells most k-mers apart
    seen = Window.partitionBy("h", *by).orderBy("pos")
    g = F.xxhash64("h", F.row_number().over(seen))
    numbered = rows.select(*by, "pos", g.alias("g"))
    # smallest of each slot: 34 bits of the hash, then the place in the text
    order = F.shiftleft(F.col("g"), 29).bitwiseAND(F.lit((1 << 63) - 1)).bitwiseOR(F.col("pos").cast("long"))
    slot = F.pmod(F.shiftrightunsigned(F.col("g"), 40), F.lit(slots)).cast("int")
    least = numbered.groupBy(*by, slot.alias("slot")).agg(F.min(order).alias("least"))
    place = F.col("least").bitwiseAND(F.lit((1 << 29) - 1))
    one = F.struct((F.col("slot") / size).cast("int").alias("t"), place.alias("pos"),
                   F.shiftright(F.col("least"), 29).alias("g"))
    held = least.groupBy(*by).agg(F.sort_array(F.collect_list(one)).alias("of"))

    def tuple_hash(i):
        members = F.transform(F.filter(F.col("of"), lambda x: x.t == i), lambda x: x.g)
        # no member: no tuple
        return F.when(F.size(members) > 0, F.shiftleft(i.cast("long"), 58).bitwiseOR(
            F.shiftrightunsigned(F.xxhash64(members), 6)))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.lit(tuples - 1)), tuple_hash), lambda x: x.isNotNull())
    return held.select(*by, found.alias("tuples"))


def likeness(a, b):
    """Share of equal tuples among those that at least one of two signatures has."""
    number = lambda c: F.transform(c, lambda x: F.shiftrightunsigned(x, 58))
    either = F.size(F.array_union(number(a), number(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def fingerprint(tuples):
    """The signature as text: 16 hexadecimal digits a tuple."""
    return F.array_join(F.transform(tuples, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def next_documents(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, ``KEY``) of ``docs`` (doc_id, ``KEY``, n), the key of the next one and ``need``, the code points to take of it."""
    keys = docs.groupBy("doc_id", *KEY).agg(F.max("n").alias("n_chars")).withColumn("_all", F.lit(0))
    ranked = rank_in_group(keys, ["_all"], [F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc()], "place")
    of = cut_lineage(ranked.select("doc_id", *KEY, "n_chars", "place"))
    # the last one is followed by the first: one aggregated row names its place
    after = of.select((F.col("place") - 1).alias("place"), *[F.col(c).alias(f"next_{c}") for c in KEY])
    last = of.agg(F.max("place").alias("n"))
    after = after.join(F.broadcast(last)).select(
        F.when(F.col("place") == 0, F.col("n")).otherwise(F.col("place")).alias("place"), *[f"next_{c}" for c in KEY])
    return of.join(after, "place").select("doc_id", *KEY, *[f"next_{c}" for c in KEY],
                                          F.floor(F.col("n_chars") / 3).cast("int").alias("need"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    the signatures (tuples, edited_tuples) of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("doc_id", text).alias("text_hash"),
                        text.alias("text"), F.length(text).alias("n"))
    at = [f"next_{c}" for c in KEY]
    follow = next_documents(keyed.drop("text"))
    # one shuffle of the texts serves all joins below: they read the same columns. A text gives
    # some thirty times its bytes as k-mer rows, so a task gets a part of a usual partition
    parts = PARTS * n_partitions(docs.sparkSession)
    own = keyed.select(*KEY, "text").repartition(parts, *KEY)
    # the start of the next text travels back to the document before it
    asked = follow.select(*[F.col(c).alias(f"for_{c}") for c in KEY], *[F.col(n).alias(c) for n, c in zip(at, KEY)], "doc_id", "need")
    # sorted joins on both sides' partitioning: whatever the sizes, nothing below moves a text again
    gift = own.join(asked.repartition(parts, *KEY).hint("merge"), KEY) \
        .select(*[F.col(f"for_{c}").alias(c) for c in KEY], *[F.col(c).alias(n) for n, c in zip(at, KEY)], "doc_id",
                F.expr("left(text, need)").alias("gift")) \
        .repartition(parts, *KEY).groupBy(*KEY).agg(F.first(F.struct("doc_id", *at, "gift")).alias("g")).select(*KEY, "g.*")
    joined = own.join(gift.hint("merge"), KEY)
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.col("gift"))
    kinds = joined.dropDuplicates(KEY).select(*KEY, F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), edited.alias("text")))).alias("of")) \
        .select(*KEY, "of.kind", "of.text")
    signed = signatures(kinds, [*KEY, "kind"]).groupBy(*KEY).agg(
        F.max(F.when(F.col("kind") == 0, F.col("tuples"))).alias("tuples"),
        F.max(F.when(F.col("kind") == 1, F.col("tuples"))).alias("edited_tuples"))
    facts = joined.select("doc_id", *KEY, *at, F.length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))
    none = F.array().cast("array<bigint>")
    done = cut_lineage(facts.join(signed.hint("merge"), KEY, "left").withColumns(
        {c: F.coalesce(c, none) for c in ("tuples", "edited_tuples")}))
    following = done.select(*[F.col(c).alias(n) for n, c in zip(at, KEY)], F.col("tuples").alias("next_tuples")).dropDuplicates(at)
    return done.join(following, at) \
        .select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("tuples")).alias("fingerprint"),
                fingerprint(F.col("edited_tuples")).alias("edited_fingerprint"),
                likeness(F.col("tuples"), F.col("edited_tuples")).alias("near_edited"),
                likeness(F.col("tuples"), F.col("next_tuples")).alias("near_next"), "tuples", "edited_tuples")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
