"""Tables written batch by batch with a commit per batch (the base of sinks S6–S8 in the jobs).

A batch writes its rows into a folder of its own try and then names that folder in one small
commit file, which replaces the batch's earlier commit in a single rename. Readers list commits
and read only folders that a commit names: half a batch is never seen, and a replayed batch takes
the place of its first try. Data and commits lie in whatever file system the path names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class BatchTable:
    """Rows under ``path``, by batch number; ``partition_by`` columns become folders."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.partition_by = spark, path.rstrip("/"), schema, partition_by

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def write(self, batch: int, rows: DataFrame, note: dict | None = None) -> None:
        self.commit(batch, self.stage(batch, rows), note)

    def stage(self, batch: int, rows: DataFrame) -> str:
        """Write a batch's rows without showing them; returns the folder to commit."""
        folder = f"batch={int(batch)}/try={uuid.uuid4().hex}"
        writer = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{folder}")
        return folder

    def write_each(self, rows: DataFrame, number: str) -> None:
        """Write the batches that the column ``number`` names in one job; each gets a commit of its
        own, which notes its row count. The numbers go through the driver."""
        name = uuid.uuid4().hex
        dealt = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], F.col(number).cast("long").alias("batch"))
        dealt.repartition("batch").withColumn("try", F.lit(name)).write.mode("append").partitionBy("batch", "try").parquet(self.path)
        for r in dealt.groupBy("batch").count().orderBy("batch").collect():
            self.commit(r["batch"], f"batch={r['batch']}/try={name}", {"rows": r["count"]})

    def commit(self, batch: int, folder: str, note: dict | None = None) -> None:
        """Show a staged batch, instead of what an earlier try of it has shown. One commit file is
        written under a name of its own and renamed; where the target exists it goes first, so at
        worst a crash leaves the batch unseen and the stream replays it."""
        fs, target = self._fs(f"{self.path}/_commits/{int(batch):012d}")
        _, fresh = self._fs(f"{self.path}/_commits/.{int(batch)}-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        try:
            out.write(bytearray(json.dumps({"folder": folder, **(note or {})}).encode()))
        finally:
            out.close()
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(fresh, target):
            raise OSError(f"batch {batch} of {self.path} could not be committed")

    def commits(self) -> dict[int, dict]:
        """Batch number -> its commit (folder and notes)."""
        fs, at = self._fs(f"{self.path}/_commits")
        if not fs.exists(at):
            return {}
        found = {}
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.isdigit():
                data = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
                stream = fs.open(s.getPath())
                try:
                    found[int(name)] = json.loads(data.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return found

    def drop(self, batch: int) -> None:
        """Take a batch out of the table (its commit goes; readers no longer see its folder)."""
        fs, at = self._fs(f"{self.path}/_commits/{int(batch):012d}")
        fs.delete(at, False)

    def read(self, since: int | None = None, before: int | None = None) -> DataFrame:
        """Committed rows with their ``batch``, of batches from ``since`` up to before ``before``.
        A replayed batch passes its own number as ``before`` and does not see its first try."""
        folders = [c["folder"] for n, c in sorted(self.commits().items())
                   if (since is None or n >= since) and (before is None or n < before)]
        full = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        if not folders:
            return self.spark.createDataFrame([], full)
        read = T.StructType([*full.fields, T.StructField("try", T.StringType())])
        return self.spark.read.schema(read).option("basePath", self.path) \
            .parquet(*[f"{self.path}/{f}" for f in folders]).select(*[f.name for f in full.fields])

    def bytes(self, since: int | None = None, before: int | None = None) -> int:
        """Bytes of the committed files of a range of batches."""
        total = 0
        for n, c in self.commits().items():
            if (since is None or n >= since) and (before is None or n < before):
                fs, at = self._fs(f"{self.path}/{c['folder']}")
                total += int(fs.getContentSummary(at).getLength())
        return total


def newest(table: BatchTable, keep: int, order: str) -> DataFrame:
    """The newest ``keep`` rows of a table by (batch, ``order``). Commits note their row counts, so
    only the batches that hold these rows are read."""
    commits = table.commits()
    held, since = 0, None
    for n in sorted(commits, reverse=True):
        held, since = held + commits[n]["rows"], n
        if held >= keep:
            break
    return table.read(since=since).orderBy(F.col("batch").desc(), F.col(order).desc()).limit(keep)


def retain(table: BatchTable, keep: int) -> list[int]:
    """Drop the batches that lie wholly behind the newest ``keep`` rows; returns their numbers.
    Reads commits only."""
    commits = table.commits()
    held, gone = 0, []
    for n in sorted(commits, reverse=True):
        if held >= keep:
            table.drop(n)
            gone.append(n)
        held += commits[n]["rows"]
    return gone
