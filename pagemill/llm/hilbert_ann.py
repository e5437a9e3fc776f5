"""Approximate nearest neighbours over shifted Hilbert curves.

Equal vectors are one class, with the smallest ids that any query can need. Each of ``CURVES``
curves projects the class vectors to a few dimensions, shifts and quantises them, and orders them
by their Hilbert key; Spark sorts all curves by one range partitioning, which also gives each class
its position on each curve. A query is compared with the classes within a window of positions
around its own, block by block; the best of all blocks and curves are merged and scored again.

The window is fitted: for a sample of at most ``SAMPLE`` queries the true neighbours are found by
brute force over all rows, and the window is the smallest that holds a ``FIT`` share of them on
some curve. Data without structure makes it wide, structured data narrow. Every row is indexed.

Nearness is the inner product in double precision. Defined cases: vectors that are null, zero, of
another length than the most common one, or that hold null or non-finite components take no part,
nor do null ids; rows of one id are each other's own and never neighbours; equal scores go to the
smaller id; fewer candidates than ``k`` are all returned if the window covers them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pagemill.llm.common import cut_lineage, n_partitions, rows_to_batches, table
from pagemill.llm.words import U64

CURVES = 8
DIMS, BITS = 4, 15      # of a curve's key: 60 bits
SAMPLE, FIT = 200, 0.97
BLOCK = 4096            # curve positions a task compares at once
K = 20
QUERY_EVERY = 20


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points with ``bits`` bits a coordinate (Skilling's transform)."""
    x = x.astype(U64, copy=True)
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        top, low = U64(1 << level), U64((1 << level) - 1)
        for i in range(dims):
            hit = (x[:, i] & top) != 0
            swap = np.where(hit, U64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, i] ^= swap
            x[:, 0] ^= np.where(hit, low, swap)
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), U64)
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[:, dims - 1] & U64(1 << level), turn ^ U64((1 << level) - 1), turn)
    x ^= turn[:, None]
    key = np.zeros(len(x), U64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << U64(1)) | ((x[:, i] >> U64(level)) & U64(1))
    return key


def curve(c: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Projection and shift of a numbered curve."""
    rng = np.random.default_rng([c, size])
    return rng.normal(size=(size, DIMS)) / np.sqrt(size), rng.uniform(0, 2 ** BITS / 8, size=DIMS)


def curve_keys(vectors: np.ndarray, c: int, centre: np.ndarray, spread: float) -> np.ndarray:
    """Keys on curve ``c``. Four deviations either side of the centre keep apart; beyond, the
    cells at the edge hold the rest."""
    project, shift = curve(c, vectors.shape[1])
    unit = (vectors - centre) @ project / (spread or 1.0)
    cells = (unit / 8 + 0.5) * (2 ** BITS * 0.875) + shift
    return hilbert_keys(np.clip(cells, 0, 2 ** BITS - 1).astype(U64), BITS)


def _matrix(col) -> np.ndarray:
    blobs = col.to_pylist()
    return np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), -1).astype(np.float64) if blobs else np.zeros((0, 1))


SLACK = 12      # classes beyond k that are scored again, for the last bits of the first product
QUERIES_AT_ONCE = 256


def _best(queries: np.ndarray, vectors: np.ndarray, ids, k: int):
    """The k nearest ids of each query among the classes ``vectors``, whose ids are a list
    array: (query number, score, id), by query, then nearest first, then smaller id."""
    bounds, flat = ids.offsets.to_numpy(), ids.flatten().to_numpy()
    bounds = bounds - bounds[0]
    single = vectors.astype(np.float32)
    out = []
    for s in range(0, len(queries), QUERIES_AT_ONCE):
        q = queries[s:s + QUERIES_AT_ONCE]
        near = q.astype(np.float32) @ single.T
        keep = min(k + SLACK, near.shape[1])
        top = np.argpartition(near, near.shape[1] - keep, axis=1)[:, -keep:] if keep < near.shape[1] \
            else np.broadcast_to(np.arange(keep), near.shape)
        row, cls = np.repeat(np.arange(len(q)), keep), top.ravel()
        # one order of summation, so that a pair has the same score wherever it is met
        score = (vectors[cls] * q[row]).sum(axis=1)
        n = bounds[cls + 1] - bounds[cls]
        begin = np.cumsum(n) - n
        own = flat[np.repeat(bounds[cls] - begin, n) + np.arange(n.sum())]
        row, score = np.repeat(row, n), np.repeat(score, n)
        order = np.lexsort((own, -score, row))
        row, score, own = row[order], score[order], own[order]
        first = np.searchsorted(row, np.arange(len(q)))
        ok = np.arange(len(row)) - first[row] < k
        out.append((row[ok] + s, score[ok], own[ok]))
    return tuple(np.concatenate(x) for x in zip(*out))


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """(vec: float32 bytes, ids: the k + 1 smallest ids), one row per distinct vector."""
    schema = pa.schema([("vec", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        held: dict[bytes, list[int]] = {}

        def rows():
            for v, ids in held.items():
                yield v, sorted(set(ids))[:k + 1]

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("vec").to_pylist()):
                own = held.setdefault(v, [])
                own.append(i)
                if len(own) > 8 * k:
                    own[:] = sorted(set(own))[:k + 1]
            if len(held) > 100_000:
                yield from rows_to_batches(rows(), schema)
                held.clear()
        yield from rows_to_batches(rows(), schema)

    return (vectors.select("vec_id", "vec").mapInArrow(run, "vec binary, ids array<long>").groupBy("vec")
            .agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")))


def usable(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec: float32 bytes) of the rows that take part."""
    v = F.col(vec_col)
    src = (embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<float>").alias("v"))
           .filter("vec_id is not null and v is not null and size(v) > 0")
           .filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
           .filter(F.exists("v", lambda x: x != 0)))
    length = src.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return src.select("vec_id", F.lit(b"").alias("vec"))
    src = src.filter(F.size("v") == length["n"])

    def run(batches):
        for b in batches:
            values = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)   # no negative zero
            rows = values.reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "vec"])

    return src.mapInArrow(run, "vec_id long, vec binary")


def moments(classes: DataFrame) -> tuple[np.ndarray, float] | None:
    """Mean and root mean square deviation of a component over all classes."""
    def run(batches):
        n, s, q = 0, 0.0, 0.0
        for b in batches:
            m = _matrix(b.column("vec"))
            if len(m):
                n, s, q = n + len(m), s + m.sum(axis=0), q + (m * m).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tolist()], "q": [q.tolist()]})

    parts = classes.select("vec").mapInArrow(run, "n long, s array<double>, q array<double>")
    one = parts.select("n", F.posexplode(F.arrays_zip("s", "q"))).groupBy("pos").agg(
        F.sum("n").alias("n"), F.sum("col.s").alias("s"), F.sum("col.q").alias("q")).orderBy("pos").collect()
    if not one:
        return None
    mean = np.array([r.s / r.n for r in one])
    return mean, float(np.sqrt(np.mean([max(0.0, r.q / r.n - (r.s / r.n) ** 2) for r in one])) or 1.0)


def positions(classes: DataFrame, centre: np.ndarray, spread: float) -> DataFrame:
    """(c, pos, cid, ids, vec): each class on each curve, positions without gaps."""
    schema = pa.schema([("c", pa.int32()), ("key", pa.int64()), ("cid", pa.int64()), ("ids", pa.list_(pa.int64())), ("vec", pa.binary())])

    def run(batches):
        for b in batches:
            m = _matrix(b.column("vec"))
            for c in range(CURVES):
                key = curve_keys(m, c, centre, spread).view(np.int64) if len(m) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), c, np.int32)), pa.array(key), b.column("cid"), b.column("ids"), b.column("vec")], schema=schema)

    spark = classes.sparkSession
    # written, so that partitions and the order within them are fixed when they are counted
    placed = cut_lineage(classes.mapInArrow(run, "c int, key long, cid long, ids array<long>, vec binary")
                         .repartitionByRange(n_partitions(spark), "c", "key", "cid").sortWithinPartitions("c", "key", "cid")
                         .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    runs = placed.groupBy("c", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("c", "part", "first", "before")
    # at most one row for each partition and curve
    return placed.join(F.broadcast(starts), ["c", "part"]).select(
        "c", (F.col("row") - F.col("first") + F.col("before")).alias("pos"), "cid", "ids", "vec")


def fitted_window(placed: DataFrame, classes: DataFrame, sample: list, k: int) -> int:
    """The smallest window that holds a ``FIT`` share of the sample's true neighbours."""
    queries = np.stack([np.frombuffer(r.vec, np.float32).astype(np.float64) for r in sample])
    names = np.array([r.cid for r in sample])

    def run(batches):
        for b in batches:
            m = _matrix(b.column("vec"))
            if len(m):
                cid = b.column("cid").to_numpy()
                one = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32), pa.array(cid))
                row, score, near = _best(queries, m, one, k + 1)
                yield pa.RecordBatch.from_pydict({"q": names[row], "cid": near, "score": score})

    found = classes.select("cid", "vec").mapInArrow(run, "q long, cid long, score double").filter("q <> cid")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    true = cut_lineage(found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "cid"))
    light = placed.select("c", "pos", "cid")
    at = light.select("c", F.col("pos").alias("at"), F.col("cid").alias("q"))
    # the sample's pairs: at most SAMPLE * k rows
    gaps = (light.join(F.broadcast(true), "cid").join(F.broadcast(cut_lineage(at.join(F.broadcast(true.select("q").distinct()), "q"))), ["c", "q"])
            .groupBy("q", "cid").agg(F.min(F.abs(F.col("pos") - F.col("at"))).alias("gap")))
    rows = sorted(r.gap for r in gaps.select("gap").collect())
    return int(rows[min(len(rows) - 1, int(np.ceil(FIT * len(rows))) - 1)]) if rows else 1


def nearest(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
            query_every: int = QUERY_EVERY) -> DataFrame:
    """For each row whose id is divisible by ``query_every``: query_id, rank, vec_id, score."""
    spark = embeddings.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = cut_lineage(usable(embeddings, id_col, vec_col))
    # equal vectors with one id in both: the class is named by its smallest id and its bytes
    classes = cut_lineage(classes_of(rows, k).withColumn("cid", F.xxhash64("vec")))
    asked = rows.filter(F.pmod("vec_id", F.lit(query_every)) == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("cid")).distinct()
    wanted = cut_lineage(asked.select("cid").distinct())
    stats = moments(classes)
    if stats is None:
        return spark.createDataFrame([], out)
    placed = cut_lineage(positions(classes, *stats))
    sample = (classes.select("cid", "vec").join(wanted, "cid", "left_semi")
              .orderBy(F.hash("cid"), "cid").limit(SAMPLE).collect())
    reach = fitted_window(placed, classes, sample, k) if sample else 1
    reach = max(reach, k)

    block = F.floor(F.col("pos") / BLOCK).cast("long")
    candidates = placed.withColumn("block", block)
    queries = (placed.join(wanted, "cid", "left_semi").select("c", "pos", "cid", "vec")
               .withColumn("block", F.explode(F.sequence(F.greatest(F.floor((F.col("pos") - reach) / BLOCK).cast("long"), F.lit(0).cast("long")),
                                                        F.floor((F.col("pos") + reach) / BLOCK).cast("long")))))
    queries = queries.toDF(*queries.columns)    # columns of its own, though both come from one table
    schema = pa.schema([("cid", pa.int64()), ("found", pa.list_(pa.struct([("s", pa.float64()), ("i", pa.int64())])))])

    def compare(key, cand, q):
        if not cand.num_rows or not q.num_rows:
            return pa.Table.from_batches([], schema)
        m, x = _matrix(cand.column("vec")), _matrix(q.column("vec"))
        row, score, near = _best(x, m, cand.column("ids").combine_chunks(), k + 1)
        bounds = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
        found = pa.StructArray.from_arrays([pa.array(-score), pa.array(near)], names=["s", "i"])
        return pa.Table.from_arrays([q.column("cid"), pa.ListArray.from_arrays(bounds, found)], schema=schema)

    met = (candidates.groupBy("c", "block").cogroup(queries.groupBy("c", "block"))
           .applyInArrow(compare, "cid long, found array<struct<s: double, i: long>>"))
    best = (met.groupBy("cid").agg(F.slice(F.array_distinct(F.sort_array(F.flatten(F.collect_list("found")))), 1, k + 1).alias("found")))
    best = cut_lineage(best)
    return (asked.join(best, "cid")
            .select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["i"] != F.col("query_id")), 1, k)).alias("p", "x"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score")))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract rows of :func:`nearest` over all embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"))
