"""Versioned snapshot store: atomic replace, incremental append and update, merge on read (K2, K3).

A version is a list of segment directories.  Each commit writes one new
directory through Spark's commit protocol and, only after that job succeeds,
appends a row to the ``_log`` Parquet table.  Readers take the highest logged
version, so a failed or half-written commit is never visible and older
versions stay readable.

* ``append`` adds rows whose keys are new; stored files stay unread.
* ``update`` adds rows that replace earlier ones of their keys (or are new); stored
  files stay as they are.  A reader drops the replaced rows by an anti-join on the
  updated keys and takes the newest row of each.
* ``commit`` replaces everything.
* ``fold`` rewrites the latest version as one segment, so that reads need no merge.

All segments of a kind are read by one scan, whatever their number.  Beside each
segment a commit writes a Bloom filter of its keys (``_keys``, in buckets of 4 KB, 16
bits a key), and logs its least and largest key: ``lookup`` and ``present`` read only
segments that may hold what is asked for, and compare the keys there.  A commit
first claims its version by creating a file (atomic on the file system).  Of two
commits that start from the same version one gets it, the other fails and changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.operators.merge import dedupe_last
from keepsake.sources.files import path_exists

LOG_SCHEMA = T.StructType([T.StructField("version", T.LongType()), T.StructField("rows", T.LongType()),
                            T.StructField("segments", T.ArrayType(T.StringType())),
                            T.StructField("updates", T.ArrayType(T.StringType())),
                            T.StructField("bits", T.LongType()), T.StructField("least", T.StringType()),
                            T.StructField("most", T.StringType())])
#: Bits of a segment's Bloom filter for each key, and its least and largest size.
KEY_BITS, FEWEST_BITS, MOST_BITS = 16, 1 << 15, 1 << 36
#: Column that a scan gets from a segment's directory name, its version.
SEGMENT = "v"


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, key: str = "id",
                 partition_by: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.keys = [c for c in (partition_by, key) if c]
        self.partition_by = partition_by

    @property
    def _log(self) -> str:
        return self.root + "/_log"

    def _read_log(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(self._log)

    def _latest(self) -> tuple[int, list[str], list[str]] | None:
        """Latest version, its segments and which of them are updates; None only if nothing was ever committed."""
        if not path_exists(self.spark, self._log):
            return None
        row = self._read_log().agg(F.max_by(F.struct("version", "segments", "updates"), "version").alias("m")).first().m
        return None if row is None else (int(row.version), list(row.segments), list(row.updates or []))

    def latest_version(self) -> int | None:
        latest = self._latest()
        return latest[0] if latest else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the latest by default), each key's newest; None before the first commit."""
        latest = self._latest()
        if latest is None:
            return None
        _, segments, updates = latest
        if version is not None and version != latest[0]:
            row = self._read_log().where(F.col("version") == version).first()
            segments, updates = list(row.segments), list(row.updates or [])
        return self._merged(segments, updates)

    def _scan(self, segments: list[str], base: str | None = None) -> DataFrame:
        """The files of some segments, with the version of each; directory names other than that stay text."""
        base = base or self.root
        inference = "spark.sql.sources.partitionColumnTypeInference.enabled"
        before = self.spark.conf.get(inference)
        self.spark.conf.set(inference, "false")
        try:
            found = self.spark.read.option("basePath", base).parquet(*[f"{base}/{s}" for s in segments])
        finally:
            self.spark.conf.set(inference, before)
        return found.withColumn(SEGMENT, F.col(SEGMENT).cast("long"))

    def _merged(self, segments: list[str], updates: list[str]) -> DataFrame:
        plain = [s for s in segments if s not in updates]
        if not updates:
            return self._scan(plain).drop(SEGMENT)
        changes = self._scan(updates)
        newest = dedupe_last(changes, self.keys, [SEGMENT]).select([c for c in changes.columns if c != SEGMENT])
        if not plain:
            return newest
        rows = self._scan(plain).drop(SEGMENT)
        replaced = changes.select(*self.keys).distinct()
        return rows.join(replaced, self.keys, "left_anti").select(rows.columns).unionByName(newest)

    @staticmethod
    def segment_name(version: int) -> str:
        return f"{SEGMENT}={version:06d}"

    def read_keys_of(self, names: list[str]) -> DataFrame | None:
        """The rows, as the latest version holds them, whose keys the given segments have; None if it has none of those."""
        latest = self._latest()
        there = [n for n in names if latest and n in latest[1]]
        if not there:
            return None
        keys = self._scan(there).select(*self.keys).distinct()
        return self._merged(*latest[1:]).join(keys, self.keys, "left_semi")

    # -- keys -----------------------------------------------------------------

    def _places(self, bits) -> Column:
        """The two bits of a key's Bloom filter entry, from 1."""
        keys = [F.col(c).cast("string") for c in self.keys]
        return F.array(*[F.pmod(F.xxhash64(F.lit(k), *keys), bits) + 1 for k in (0, 1)])

    def _note_keys(self, name: str, rows: int) -> tuple[int | None, str | None, str | None]:
        """Writes the Bloom filter of a segment's keys; (its bits, least and largest key)."""
        if not rows:
            return None, None, None
        bits = FEWEST_BITS
        while bits < KEY_BITS * rows and bits < MOST_BITS:
            bits *= 2
        keys = self._scan([name]).select(*self.keys)
        placed = keys.select(F.explode(self._places(F.lit(bits))).alias("at"))
        (placed.groupBy(F.bitmap_bucket_number("at").alias("bucket"))
         .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
         .sort("bucket").write.mode("overwrite").parquet(f"{self.root}/_keys/{name}"))
        last = F.col(self.keys[-1]).cast("string")
        ends = keys.agg(F.min(last).alias("least"), F.max(last).alias("most")).first()
        return bits, ends.least, ends.most

    def segments_of(self, keys: DataFrame) -> list[str]:
        """The latest version's segments that may hold one of ``keys`` (a few more is possible, fewer is not)."""
        latest = self._latest()
        if latest is None:
            return []
        noted = {self.segment_name(r.version): r for r in self._read_log().collect()}  # a row per commit
        known = [(s, noted[s]) for s in latest[1] if noted[s].bits]
        found = {s for s in latest[1] if not noted[s].bits and noted[s].rows}  # of before filters were written
        if known:
            last = F.col(self.keys[-1]).cast("string")
            each = F.array(*[F.struct(F.lit(r.version).alias(SEGMENT), F.lit(r.bits).alias("size"), F.lit(r.least).alias("least"),
                                      F.lit(r.most).alias("most")) for _, r in known])
            asked = keys.select(*self.keys).distinct().withColumn("s", F.explode(each)).where(
                last.between(F.col("s.least"), F.col("s.most")))
            asked = asked.select(*self.keys, F.col(f"s.{SEGMENT}").alias(SEGMENT), F.explode(self._places(F.col("s.size"))).alias("at"))
            asked = asked.select(*self.keys, SEGMENT, F.bitmap_bucket_number("at").alias("bucket"),
                                 F.bitmap_bit_position("at").alias("at"))
            stored = self._scan([s for s, _ in known], f"{self.root}/_keys")
            byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
            is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0
            hits = asked.join(stored, [SEGMENT, "bucket"]).where(is_set).groupBy(*self.keys, SEGMENT).agg(
                F.count(F.lit(1)).alias("n_set"))
            found |= {self.segment_name(r[0]) for r in hits.where("n_set = 2").select(SEGMENT).distinct().collect()}
        return [s for s in latest[1] if s in found]

    def present(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (with the store's key columns) that the latest version holds."""
        asked = keys.select(*self.keys).distinct()
        segments = self.segments_of(asked)
        if not segments:
            return asked.limit(0)
        return self._scan(segments).select(*self.keys).join(asked, self.keys, "left_semi").distinct()

    def lookup(self, *key: str) -> DataFrame | None:
        """The row of one key, from the segments that may hold it; None before the first commit."""
        latest = self._latest()
        if latest is None:
            return None
        same = F.lit(True)
        for column, value in zip(self.keys, key, strict=True):
            same = same & (F.col(column) == F.lit(value))
        one = self.spark.range(1).select(*[F.lit(v).alias(c) for c, v in zip(self.keys, key)])
        segments = self.segments_of(one)
        if not segments:
            return self._scan(latest[1][-1:]).drop(SEGMENT).limit(0)
        rows = self._scan(segments).where(same)
        return dedupe_last(rows, self.keys, [SEGMENT]).select([c for c in rows.columns if c != SEGMENT])

    def commit(self, df: DataFrame) -> int:
        """Write ``df`` as the whole next version; returns it."""
        return self._write(df, keep=False)

    def append(self, df: DataFrame) -> int:
        """Write ``df``, whose keys are new, as a segment added to the latest version; returns the new version."""
        return self._write(df, keep=True)

    def update(self, df: DataFrame) -> int:
        """Write ``df`` as rows that replace those of the same keys, one row per key; returns the new version."""
        return self._write(df, keep=True, update=True)

    def fold(self) -> int | None:
        """Rewrite the latest version as one segment if it has several; returns the version that readers get."""
        latest = self._latest()
        if latest is None or len(latest[1]) < 2:
            return latest[0] if latest else None
        return self.commit(self._merged(*latest[1:]))

    def _write(self, df: DataFrame, keep: bool, update: bool = False) -> int:
        latest = self._latest()
        v, before, updates = (latest[0] + 1, *latest[1:]) if latest else (1, [], [])
        claim = self._claim(v)
        try:
            name = self.segment_name(v)
            obs = Observation("commit")
            # range partitions: sorted files whose statistics let a lookup by key skip the others
            placed = df.repartitionByRange(*([self.buckets] if self.buckets else []), *self.keys).sortWithinPartitions(*self.keys)
            # counted behind the exchange: finding its ranges reads the rows before it once more
            writer = placed.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
            if self.partition_by:
                writer = writer.partitionBy(self.partition_by)
            # an unlogged directory is what a failed commit left; nobody reads it
            writer.parquet(f"{self.root}/{name}")
            n = int(obs.get["rows"])
            row = (v, n, (before if keep else []) + [name], (updates if keep else []) + ([name] if update else []),
                   *self._note_keys(name, n))
            self.spark.createDataFrame([row], LOG_SCHEMA).write.mode("append").parquet(self._log)
        finally:
            self._release(claim)
        return v

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _claim(self, version: int):
        fs, path = self._fs(f"{self.root}/_claims/{version:06d}")
        if not fs.createNewFile(path):
            raise RuntimeError(f"version {version} of {self.root} is being written by another commit; if that has "
                               f"died, remove {path.toString()}")
        if (self.latest_version() or 0) >= version:
            self._release((fs, path))
            raise RuntimeError(f"version {version} of {self.root} was committed meanwhile")
        return fs, path

    @staticmethod
    def _release(claim) -> None:
        fs, path = claim
        fs.delete(path, False)
