"""A table kept in buckets of files, of which a batch rewrites the ones it touches and publishes all at once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """path/data/v=N/bucket=B holds bucket B as version N left it; path/manifest/N names the batch that made version N, and for each bucket the version its rows are in.

    A manifest is written beside its place and renamed into it, so readers see all of a batch or nothing of it. Data and manifests are removed
    once none of the newest `keep` manifests names them: a bucket has `keep` copies at most, besides what a batch is just writing, and a reader
    has until the keep-th later batch to finish. Each bucket is one file, rewritten whole, so there is nothing to compact.
    All file work goes through Hadoop's file systems, on any of which this runs.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64, keep: int = 2):
        if keep < 2:
            raise ValueError("readers and batches that are run again need the version before")
        self.spark, self.path, self.schema, self.key, self.buckets, self.keep = spark, path.rstrip("/"), schema, key, buckets, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def published(self) -> list[int]:
        """Versions that have a manifest, in order."""
        return sorted(int(n) for n in self._names("manifest") if n.isdigit())

    def manifest(self, n: int) -> tuple[list, dict[int, int]]:
        """The run and batch of version n, and the version of each bucket's rows."""
        stream = self._fs.open(self._path(f"{self.path}/manifest/{n}"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return found["batch"], {int(b): v for b, v in found["buckets"].items()}

    def _publish(self, n: int, batch: list, versions: dict[int, int]) -> None:
        beside, place = self._path(f"{self.path}/manifest/.{n}.new"), self._path(f"{self.path}/manifest/{n}")
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps({"batch": batch, "buckets": versions}).encode()))
        out.close()
        if self._fs.exists(place):  # of an earlier try of this batch
            self._fs.delete(place, False)
        if not self._fs.rename(beside, place):
            raise OSError(f"couldn't publish {place}")

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())])

    def current(self) -> DataFrame:
        """The rows of the newest manifest; the files of no other version are listed or read."""
        known = self.published()
        return self._rows(self.manifest(known[-1])[1] if known else {})

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def update(self, new: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame], run: str = "") -> None:
        """merge(old, new) takes the place of the buckets that new's keys are in, as a new version.

        If the newest version is of the same run and batch, it was made by an earlier try; this one starts from the version before and takes its place.
        A run is one stream's checkpoint; a new one counts its batches from 0 again, on top of what is there.
        """
        known = self.published()
        newest = known[-1] if known else -1
        again = bool(known) and self.manifest(newest)[0] == [run, batch]
        n = newest if again else newest + 1
        versions = self.manifest(n - 1)[1] if n - 1 in known else {}
        touched = [r.bucket for r in new.select(self.bucket().alias("bucket")).distinct().collect()]  # no more rows than buckets
        old = self._rows({b: versions[b] for b in touched if b in versions})
        rows = merge(old, new).withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={n}")
        self._publish(n, [run, batch], {**versions, **dict.fromkeys(touched, n)})
        self._clean()

    def _clean(self) -> None:
        known = self.published()
        kept = known[-self.keep :]
        named = {(v, b) for n in kept for b, v in self.manifest(n)[1].items()}
        for name in self._names("data"):
            v = int(name.removeprefix("v="))
            if v > known[-1]:
                continue
            own = [b for b in self._names(f"data/{name}") if b.startswith("bucket=")]
            gone = [b for b in own if (v, int(b.removeprefix("bucket="))) not in named]
            for at in [f"{name}/{b}" for b in gone] if len(gone) < len(own) else [name]:
                self._fs.delete(self._path(f"{self.path}/data/{at}"), True)
        for n in known[: -self.keep]:
            self._fs.delete(self._path(f"{self.path}/manifest/{n}"), False)
