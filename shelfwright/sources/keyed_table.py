"""A keyed table that takes upserts batch by batch: changes are appended, and only touched key buckets are compacted."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright.sources.tables import upsert


class KeyedTable:
    """Newest row per key under ``root``, in the cluster's shared storage.

    ``base/generation=g/bucket=b`` holds whole buckets, ``changes/batch=n/bucket=b`` the newest rows of a batch, and ``log`` one
    row for every completed step: which buckets a batch changed, and which generation of a bucket holds all batches up to which one. A reader
    merges the last generation of each bucket with the later batches; what no log row names is not looked at, so a step
    that was broken off is simply done again. A batch writes as many bytes as it has keys; a bucket is rewritten
    when ``most_changes`` batches have changed it. The driver holds one log row per bucket (``buckets`` bounds them).
    """

    LOG = "kind string, bucket int, batch long, generation long"

    def __init__(self, spark: SparkSession, root: str, key: str, version: str, schema, buckets: int = 64, most_changes: int = 8):
        self.spark, self.root, self.key, self.version, self.schema = spark, root, key, version, schema
        self.buckets, self.most_changes = buckets, most_changes

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.LOG).parquet(f"{self.root}/log")
        except AnalysisException:  # nothing is written yet
            return self.spark.createDataFrame([], self.LOG)

    def _done(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def exists(self) -> bool:
        return not self._log().isEmpty()

    def _write(self, rows: DataFrame, place: str) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{place}")

    def create(self, rows: DataFrame) -> None:
        """The first generation; a table that exists is left as it is."""
        if not self.exists():
            self._write(upsert(rows.limit(0), rows, self.key, self.version), "base/generation=0")
            self._done([("base", b, -1, 0) for b in range(self.buckets)])

    def apply(self, batch: DataFrame, number: int) -> None:
        """The newest row per key of batch ``number``; a batch that is given again is not applied twice."""
        if self._log().where((F.col("kind") == "changes") & (F.col("batch") == number)).isEmpty():
            place = f"changes/batch={number}"
            self._write(upsert(batch.limit(0), batch, self.key, self.version), place)
            touched = self._placed("changes", "batch").where(F.col("batch") == number).select("bucket").distinct().collect()  # at most ``buckets`` rows
            self._done([("changes", r.bucket, number, None) for r in touched] or [("changes", -1, number, None)])
        self.compact(number)

    def _state(self) -> dict[int, tuple[int, int, int]]:
        """Per bucket: generation, last batch in it, and changes since."""
        log = self._log()
        base = log.where("kind = 'base'").groupBy("bucket").agg(F.max(F.struct("generation", "batch")).alias("b"))
        later = log.where("kind = 'changes'").select("bucket", "batch").distinct().join(base, "bucket").where("batch > b.batch").groupBy("bucket").agg(F.count("*").alias("n"))
        return {r.bucket: (r.b.generation, r.b.batch, r.n or 0) for r in base.join(later, "bucket", "left").select("bucket", "b", "n").collect()}

    def compact(self, number: int, all_buckets: bool = False) -> list[int]:
        """Merge the buckets with enough changes up to batch ``number`` into a new generation; the others are not read."""
        state = self._state()
        full = sorted(b for b, (_, _, n) in state.items() if n >= (1 if all_buckets else self.most_changes))
        if full:
            generation = max(g for g, _, _ in state.values()) + 1
            self._write(self._merged(state, full, number), f"base/generation={generation}")
            self._done([("base", b, number, generation) for b in full])
        return full

    def _merged(self, state: dict, buckets: list[int], number: int | None = None) -> DataFrame:
        """Rows of some buckets; folders of other buckets, older generations and folded batches are pruned."""
        which = {b: state[b] for b in buckets}
        at = lambda k: F.element_at(F.create_map(*[x for b, v in which.items() for x in (F.lit(b), F.lit(v[k]).cast("long"))]), F.col("bucket"))
        here = F.col("bucket").isin(buckets)
        columns = [f.name for f in self.schema.fields]
        rows = self._placed("base", "generation").where(here & (F.col("generation") == at(0))).select(columns)
        done = [r.batch for r in self._log().where("kind = 'changes'").where(F.col("batch") > min(v[1] for v in which.values())).select("batch").distinct().collect()]  # since the last compactions
        if done:
            new = self._placed("changes", "batch").where(here & F.col("batch").isin(done) & (F.col("batch") > at(1)))
            rows = rows.unionByName((new if number is None else new.where(F.col("batch") <= number)).select(columns))
        return upsert(rows.limit(0), rows, self.key, self.version).select(columns)

    def _placed(self, folder: str, level: str) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(level, T.LongType()), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{folder}").parquet(f"{self.root}/{folder}")

    def read(self) -> DataFrame:
        """The newest row of every key."""
        state = self._state()
        return self._merged(state, sorted(state))


class KeyLedger:
    """Keys seen so far, appended batch by batch; a batch given again writes the same keys again."""

    def __init__(self, spark: SparkSession, root: str, schema):
        self.spark, self.root, self.schema = spark, root, schema

    def _before(self, number: int) -> DataFrame | None:
        full = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        try:
            return self.spark.read.schema(full).option("basePath", self.root).parquet(self.root).where(F.col("batch") < number).drop("batch")
        except AnalysisException:  # the first batch
            return None

    def add(self, keys: DataFrame, number: int) -> None:
        """Keep the keys of a batch that no earlier one had; nulls are keys like others."""
        new, seen = keys.dropDuplicates(), self._before(number)
        if seen is not None:
            same = None
            for c in keys.columns:
                one = new[c].eqNullSafe(seen[c])
                same = one if same is None else same & one
            new = new.join(seen, same, "left_anti")
        new.write.mode("overwrite").parquet(f"{self.root}/batch={number}")

    def read(self) -> DataFrame:
        found = self._before(2 ** 62)
        return self.spark.createDataFrame([], self.schema) if found is None else found
