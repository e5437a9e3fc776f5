"""MinHash near-duplicates with odd sketches.

A text's set holds the distinct hashes of its five-word shingles. Equal sets are one class
from the start, and only class representatives go on. ``BANDS`` x ``ROWS`` MinHash values give
band keys; representatives with an equal key share a bucket. The MinHash samples are also
folded into an odd sketch, a bitmap of parities, so that the population count of the XOR of two
sketches estimates their similarity; it sorts out weak candidates before full sets are read.

Links are found without forming all pairs of a bucket:

1. In the buckets of the first bands every member meets the smallest member. Candidates that pass
   the sketch are confirmed on full sets, and the links' components are formed.
2. Buckets of all bands that span several components are gathered by the component of their smallest
   member. Members outside it are compared with all others by sketch, in blocks of bounded size;
   a task reports which members have an open candidate, not the candidates.
3. Reported members meet again in blocks, now with their full sets, and a task reports the links
   that connect them, one for each member at most.

Nothing is capped, so no link that a bucket holds is lost from the components.

A pair of similarity 0.75 shares no bucket with probability (1 - 0.75**4)**40 = 2.5e-7. The
sketch is cut at six standard deviations.

Defined cases: null, empty or blank texts have an empty set, link with nothing and are kept; a
text of fewer words than a shingle is one shingle; null ids take no part and are kept; rows of
one id count as one document, whose links are united.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import U64, cut_lineage, groups, ids_of, n_partitions, table, tidy, u64
from pagemill.llm.components import components
from pagemill.llm.words import mix, multipliers, ngrams, slices, split_words

SHINGLE = 5
PERCENT = 75        # similarity of a link, in hundredths
BANDS, ROWS = 40, 4
SKETCH_BITS = 512
SKETCH_MOST = 125   # XOR population count; 0.75 gives 69 on average
STARS = 8           # bands whose buckets form stars
BLOCK = 256         # bucket members that a task compares with as many others
SEND_IDS = 2_000_000   # ids to confirm (16 MB) up to which they are sent to the scan instead of a shuffle

_A = multipliers(BANDS * ROWS, 101)
_B = multipliers(BANDS * ROWS, 102)
_BAND = multipliers(BANDS, 103)


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of each text's part, sorted distinct shingle hashes of the texts)."""
    w = split_words(col, lower=True)
    doc_of = w.doc()
    at, h = ngrams(w, SHINGLE)
    parts = [(doc_of[at], h)]
    for n in range(1, SHINGLE):
        short = w.counts == n
        if short.any():
            at, h = ngrams(w, n)
            ok = short[doc_of[at]]
            parts.append((doc_of[at][ok], h[ok]))
    doc, h = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
        doc, h = doc[new], h[new]
    return np.searchsorted(doc, np.arange(len(w.first))), h


SKETCH = "doc_id long, n long, node binary, bands array<long>, odd array<long>"
_SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()),
                           ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])


@tidy
def _sketches(batches):
    for whole in batches:
        for b in slices(whole):
            bounds, h = shingle_sets(b.column("text"))
            n = np.diff(bounds)
            has = np.flatnonzero(n)
            start = bounds[:-1][has]
            k = BANDS * ROWS
            low = np.empty((len(has), k), U64)
            node = np.empty((len(has), 2), U64)
            with np.errstate(over="ignore"):
                if len(has):
                    for j in range(k):
                        low[:, j] = np.minimum.reduceat(h * _A[j] + _B[j], start)
                    node[:, 0] = np.add.reduceat(mix(h ^ _A[0]), start)
                    node[:, 1] = np.add.reduceat(mix(h ^ _A[1]), start)
                bands = low.reshape(len(has), BANDS, ROWS)
                keys = np.zeros((len(has), BANDS), U64)
                for r in range(ROWS):
                    keys = mix(keys ^ bands[:, :, r]) + _BAND
                bit = mix(mix(low) + _A) % U64(SKETCH_BITS)
            odd = np.zeros((len(has), SKETCH_BITS // 64), U64)
            rows = np.repeat(np.arange(len(has)), k)
            np.bitwise_xor.at(odd, (rows, (bit >> U64(6)).ravel().astype(np.int64)), U64(1) << (bit & U64(63)).ravel())
            empty = np.ones(len(n), bool)
            empty[has] = False
            at = np.cumsum(~empty) - 1
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(n.astype(np.int64)),
                pa.array([None if e else node[a].tobytes() for e, a in zip(empty, at)], pa.binary()),
                pa.array([None if e else keys[a].view(np.int64) for e, a in zip(empty, at)], pa.list_(pa.int64())),
                pa.array([None if e else odd[a].view(np.int64) for e, a in zip(empty, at)], pa.list_(pa.int64())),
            ], schema=_SKETCH_ARROW)


@tidy
def _sets(batches):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])
    for whole in batches:
        for b in slices(whole):
            bounds, h = shingle_sets(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([h[s:e].tobytes() for s, e in zip(bounds, bounds[1:])], pa.binary())], schema=schema)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


@tidy
def _confirm(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for t in batches:
        keep = pa.array([_similar(u64(x.as_py()), u64(y.as_py())) for x, y in zip(t.column("sa"), t.column("sb"))], pa.bool_())
        yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], schema=schema)


def _far(a, b):
    """Population count of the XOR of two sketches."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def _sets_of(src: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents named in ``ids``."""
    ids = cut_lineage(ids.distinct())
    known = F.broadcast(ids) if ids.count() <= SEND_IDS else ids
    return src.withColumnRenamed("doc_id", "id").join(known, "id", "left_semi").mapInArrow(_sets, "id long, shingles binary")


def _confirmed(src: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    sets = _sets_of(src, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    return (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
            .mapInArrow(_confirm, "a long, b long").distinct())


def _in_blocks(compare, out: pa.Schema):
    """Run ``compare`` on the rows of each block pair of partitions sorted by ``pair``."""
    def run(batches):
        rest = None
        for t in batches:
            t = pa.Table.from_batches([t])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            pair = t.column("pair").to_numpy()
            cut = int(np.searchsorted(pair, pair[-1], side="left"))
            rest = t.slice(cut)
            yield from compare(t.slice(0, cut), out)
        if rest is not None and rest.num_rows:
            yield from compare(rest, out)

    return run


def _candidates(t: pa.Table):
    """(row, rows of other components and blocks that its size and sketch allow, nearest first)."""
    if not t.num_rows:
        return
    pair, side, n, comp = (t.column(c).to_numpy() for c in ("pair", "side", "n", "comp"))
    odd = t.column("odd").combine_chunks().flatten().to_numpy().view(U64).reshape(t.num_rows, -1)
    for s, e in zip(*groups(pair)):
        left, right = np.flatnonzero(side[s:e] != 1) + s, np.flatnonzero(side[s:e] != 0) + s
        for i in left:
            ok = comp[right] != comp[i]
            ok &= 100 * np.minimum(n[right], n[i]) >= PERCENT * np.maximum(n[right], n[i])
            other = right[ok]
            if len(other):
                far = np.bitwise_count(odd[other] ^ odd[i]).sum(axis=1)
                near = far <= SKETCH_MOST
                if near.any():
                    yield i, other[near][np.argsort(far[near], kind="stable")]


def _open_members(t: pa.Table, out: pa.Schema):
    rep, grp = t.column("rep").to_numpy(), t.column("grp").to_numpy()
    found = set()
    for i, near in _candidates(t):
        found.add((grp[i], rep[i]))
        found.update((grp[i], r) for r in rep[near])
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=out)


def _open_links(t: pa.Table, out: pa.Schema):
    """Links that connect components, each once."""
    if not t.num_rows:
        return
    rep, comp, pair = (t.column(c).to_numpy() for c in ("rep", "comp", "pair"))
    sets = t.column("shingles")
    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for i, near in _candidates(t):
        own = u64(sets[int(i)].as_py())
        for j in near:
            a, b = top((pair[i], comp[i])), top((pair[i], comp[j]))
            if a != b and _similar(own, u64(sets[int(j)].as_py())):
                parent[a] = b
                found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=out)


def _dealt(members: DataFrame, shards: int, *more: str) -> DataFrame:
    """Members (grp, rep, n, comp, odd) as blocks that are to be compared: those outside the
    group's own component with each other and with those in it."""
    members = members.withColumn("own", F.col("comp") == F.col("grp"))
    size = cut_lineage(members.groupBy("grp").agg(F.count_if("own").alias("inner"), F.count_if(~F.col("own")).alias("outer"))
                       .filter("outer > 0"))
    def blocks(c):
        return F.greatest(F.ceil(F.col(c) / BLOCK).cast("long"), F.lit(1).cast("long"))
    r = F.xxhash64("rep")
    members = members.join(size, "grp").withColumn("mine", F.pmod(r, F.when(F.col("own"), blocks("inner")).otherwise(blocks("outer"))))
    def each(c):
        return F.sequence(F.lit(0).cast("long"), blocks(c) - 1)
    def place(kind, a, b, side):
        return F.struct(F.xxhash64("grp", F.lit(kind), a, b).alias("pair"), side.cast("int").alias("side"))
    mine = F.col("mine")
    among = F.transform(each("outer"), lambda j: place(0, F.least(mine, j), F.greatest(mine, j),
                                                      F.when(mine == j, 2).when(mine < j, 0).otherwise(1)))
    outer = F.concat(among, F.when(F.col("inner") > 0, F.transform(each("inner"), lambda j: place(1, mine, j, F.lit(0))))
                     .otherwise(F.array().cast("array<struct<pair: bigint, side: int>>")))
    inner = F.transform(each("outer"), lambda j: place(1, j, mine, F.lit(1)))
    return (members.withColumn("at", F.explode(F.when(F.col("own"), inner).otherwise(outer)))
            .select("at.pair", "at.side", "grp", "rep", "n", "comp", "odd", *more)
            .repartition(shards, "pair").sortWithinPartitions("pair"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest linked id), kept."""
    shards = n_partitions(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut_lineage(src.mapInArrow(_sketches, SKETCH))
    reps = cut_lineage(rows.filter("node is not null and doc_id is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd")))
    sketch = reps.select("rep", "n", "odd")

    member = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    # written, so that the join below has a shuffle of its own, whose hot buckets Spark can split
    bucket = cut_lineage(member.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("m"))
                         .filter("low < high").select("key", "low", "m"))
    member = cut_lineage(member.join(bucket, "key"))

    def close(pairs: DataFrame) -> DataFrame:
        left = sketch.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
        right = sketch.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
        return (pairs.join(left, "a").join(right, "b")
                .filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
                .filter(_far("oa", "ob") <= SKETCH_MOST).select("a", "b").distinct())

    star = member.filter(F.col("band") < STARS).select(F.col("low").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
    links = cut_lineage(_confirmed(src, cut_lineage(close(star))))
    found = components(links)

    # buckets that span several components: the pairs that no star covered
    comps = found.select(F.col("v").alias("rep"), "comp")
    open_ = (member.filter((F.col("m") > 2) | (F.col("band") >= STARS)).select("key", "rep", "low").join(comps, "rep", "left")
             .select("key", "rep", "low", F.coalesce("comp", "rep").alias("comp")))
    mixed = cut_lineage(open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key"))
    grouped = cut_lineage(
        open_.join(mixed, "key").join(found.select(F.col("v").alias("low"), F.col("comp").alias("of_low")), "low", "left")
        .select(F.coalesce("of_low", "low").alias("grp"), "rep", "comp").distinct().join(sketch, "rep"))
    flagged = cut_lineage(_dealt(grouped, shards).mapInArrow(
        _in_blocks(_open_members, pa.schema([("grp", pa.int64()), ("rep", pa.int64())])), "grp long, rep long").distinct())
    if not flagged.isEmpty():
        left = (grouped.join(flagged, ["grp", "rep"])
                .join(_sets_of(src, flagged.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep"), "rep"))
        more = _dealt(left, shards, "shingles").mapInArrow(
            _in_blocks(_open_links, pa.schema([("a", pa.int64()), ("b", pa.int64())])), "a long, b long").distinct()
        # over components instead of documents
        comp_of = found.select(F.col("v").alias("x"), F.col("comp").alias("cx"))
        merged = components(more.join(comp_of.withColumnRenamed("x", "a").withColumnRenamed("cx", "ca"), "a", "left")
                            .join(comp_of.withColumnRenamed("x", "b").withColumnRenamed("cx", "cb"), "b", "left")
                            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        top = merged.select(F.col("v").alias("comp"), F.col("comp").alias("top"))
        found = (found.join(top, "comp", "left").select("v", F.coalesce("top", "comp").alias("comp"))
                 .unionByName(merged.join(found, "v", "left_anti")))

    of_class = (reps.select("node", "rep").join(found, F.col("rep") == F.col("v"), "left")
                .select("node", F.coalesce("comp", "rep").alias("comp")))
    linked = rows.filter("node is not null and doc_id is not null").select("doc_id", "n", "node").join(of_class, "node") \
        .select("doc_id", "n", "comp")
    alone = rows.filter("node is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("comp"))
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract rows of :func:`near_duplicates` over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS v, a AS r FROM edges UNION SELECT reach.v, edges.b FROM reach JOIN edges ON reach.r = edges.a),
comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, d.doc_id = coalesce(comp.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.v = d.doc_id
"""
