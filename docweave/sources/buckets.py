"""A table in hash buckets of its key, merged bucket by bucket.

Rows lie in ``rows/version=<n>/bucket=<b>``; a manifest per version tells which versions of a
bucket are live. A merge writes one new version: buckets that only gain keys get a file more,
buckets that hold a changed key, or many small files, are written anew, all others stay
untouched. Each key is live once, so readers need neither a group nor a join. The
manifest comes last and makes the merge visible at once; a merge that fails before
leaves the table as it was, and one that is repeated under the same ``run`` and ``batch``
changes nothing. There is one writer at a time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import work_path

BUCKETS = 16
#: Live versions of a bucket from which a merge that touches it writes it anew.
DELTAS = 8
ROWS_PER_FILE = 1_000_000

_MANIFEST = "bucket int, live int, buckets int, run string, batch long"


class Merged(NamedTuple):
    """What a merge did: its version, and buckets that got a file more or were written anew."""

    version: int
    appended: list[int]
    rewritten: list[int]


class BucketTable:
    """A bucketed table at ``path``, made by its first merge; no key is null."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _state(self) -> tuple[int, list[tuple[int, int]]]:
        """Newest version, and its live (bucket, version) pairs: at most ``DELTAS`` per bucket."""
        known = self._manifests()
        last = known.agg(F.max("version")).first()[0] if known is not None else None
        if last is None:
            return -1, []
        rows = known.where(F.col("version") == last).collect()
        if rows[0]["buckets"] != self.buckets:
            raise ValueError(f"the table has {rows[0]['buckets']} buckets")
        return last, [(r["bucket"], r["live"]) for r in rows if r["bucket"] is not None]

    def _done(self, run: str | None, batch: int | None) -> bool:
        known = self._manifests() if run is not None else None
        return known is not None and not known.where((F.col("run") == run) & (F.col("batch") == batch)).isEmpty()

    def _live(self, pairs: list[tuple[int, int]]) -> DataFrame:
        """Rows of live files; versions and buckets are partitions, so others are not listed as input."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        wanted: dict[int, list[int]] = {}
        for bucket, live in pairs:
            wanted.setdefault(live, []).append(bucket)
        cond = F.lit(False)
        for live, mine in sorted(wanted.items()):
            cond = cond | ((F.col("version") == live) & F.col("bucket").isin(sorted(mine)))
        return rows.where(cond)

    def read(self) -> DataFrame:
        """All live rows, one per key."""
        version, pairs = self._state()
        if version < 0:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._live(pairs).drop("version", "bucket")

    def merge(self, updates: DataFrame, sequence: str | None = None, run: str | None = None, batch: int | None = None) -> Merged:
        """Replace rows with the keys of ``updates`` and add the new ones.

        Of several updates of a key the one with the highest ``sequence`` wins, without
        ``sequence`` any of them. ``run`` and ``batch`` name a piece of work that counts once.
        """
        version, pairs = self._state()
        if self._done(run, batch):
            return Merged(version, [], [])
        fields = [c for c in updates.columns if c not in (*self.keys, sequence)]
        if sequence is None:
            newest = updates.dropDuplicates(self.keys)
        else:
            newest = updates.groupBy(*self.keys).agg(F.max_by(F.struct(*fields), F.col(sequence)).alias("_new"))
            newest = newest.select(*self.keys, "_new.*")
        path = work_path(self.spark, "staged")
        newest.withColumn("bucket", self._bucket()).write.parquet(path)
        staged = self.spark.read.parquet(path)
        sizes = staged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``buckets``
        touched = {r["bucket"] for r in sizes}
        there = [p for p in pairs if p[0] in touched]
        changed: set[int] = set()
        if there:
            held = self._live(there).select("bucket", *self.keys).join(staged.select(*self.keys), self.keys, "left_semi")
            changed = {r["bucket"] for r in held.select("bucket").distinct().collect()}
        counts: dict[int, int] = {}
        for bucket, _ in there:
            counts[bucket] = counts.get(bucket, 0) + 1
        rewritten = sorted(changed | {b for b, n in counts.items() if n >= DELTAS})
        out = staged
        if rewritten:
            kept = self._live([p for p in there if p[0] in set(rewritten)]).drop("version")
            out = kept.join(staged.select(*self.keys), self.keys, "left_anti").unionByName(staged, allowMissingColumns=True)
        version += 1
        if touched:
            parts = -(-max(r["n"] for r in sizes) // ROWS_PER_FILE)  # tasks for one bucket
            spread = F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(parts))
            (
                out.repartition("bucket", spread)
                .write.mode("overwrite")  # of an attempt that never got its manifest
                .option("maxRecordsPerFile", ROWS_PER_FILE)
                .partitionBy("bucket")
                .parquet(f"{self.path}/rows/version={version}")
            )
        now = [p for p in pairs if p[0] not in set(rewritten)] + [(b, version) for b in sorted(touched)]
        lines = [(b, v, self.buckets, run, batch) for b, v in now] or [(None, None, self.buckets, run, batch)]
        manifest = self.spark.createDataFrame(lines, _MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return Merged(version, sorted(touched - set(rewritten)), rewritten)
