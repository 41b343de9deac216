"""Incremental analysis of stored answers: only what a batch touches is read and computed again, and every table of the analysis is kept.

*Bronze* is clustered by a bucket of the run, so a batch reads the buckets of its own runs (partition filters) and no history of others.
*Gold* has one folder per table and generation; the rows of an answer are those of its last generation. A batch that is run again overwrites its own
folders, so every write is idempotent, and fresh answers are never written again.
*Causes.* An answer is computed again for new events in its scope, for a late reference (an event arrives that an earlier one names; the
targets still waited for are a table), and for a changed declaration of its scope (digests of the scopes are a table).
*Counts* come from observed metrics of the writes; nothing is scanned for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.hashing import agg_set_lanes
from ..operators.evidence import scope_events
from ..plans.analysis import Analysis
from .live import freshness_of, signatures

BUCKETS = 64
#: Tables of the analysis that are kept, each with a column ``aid``.
FRAMES = ("sources", "evidence", "claims", "missing", "checks", "conflicts", "under", "support_rows", "verdicts", "answer_support", "references", "checkpoints")
INVALIDATION = ["aid", "cause", "input_id", "invalidated_id"]


def new_inputs(fresh: DataFrame, answers: DataFrame, scope: DataFrame) -> DataFrame:
    """(aid, cause, input_id, invalidated_id) for each event of ``fresh`` in the scope of an answer."""
    found = scope_events(fresh.select("run_id", "event_id"), answers, scope)
    return found.select("aid", F.lit("NEW_INPUT").alias("cause"), F.col("event_id").alias("input_id"), F.lit(None).cast("string").alias("invalidated_id"))


def late_references(fresh: DataFrame, earlier: DataFrame, answers: DataFrame, scope: DataFrame) -> DataFrame:
    """For each event of ``fresh`` that a relation (run_id, event_id, target_event_id, sequence) of ``earlier`` names before it arrives, in every answer that holds both."""
    arrived = fresh.select("run_id", F.col("event_id").alias("target_event_id"), F.col("sequence").alias("_arrived"), F.col("batch").alias("_batch"))
    before = (F.col("batch") < F.col("_batch")) | ((F.col("batch") == F.col("_batch")) & (F.col("sequence") < F.col("_arrived")))
    pairs = earlier.join(arrived, ["run_id", "target_event_id"]).where(before).select("run_id", "event_id", "target_event_id")
    named = scope_events(pairs, answers, scope)
    target = scope_events(pairs.select("run_id", F.col("target_event_id").alias("event_id")).distinct(), answers, scope).select("aid", F.col("event_id").alias("target_event_id"))
    both = named.join(target, ["aid", "target_event_id"])
    return both.select("aid", F.lit("LATE_REFERENCE").alias("cause"), F.col("target_event_id").alias("input_id"), F.col("event_id").alias("invalidated_id")).distinct()


def references_of(events: DataFrame) -> DataFrame:
    """Relations inside a run: (run_id, event_id, sequence, batch, target_event_id)."""
    rows = events.select("run_id", "event_id", "sequence", "batch", F.explode("relations").alias("r"))
    return rows.where(F.coalesce(F.col("r.target_run_id"), F.col("run_id")) == F.col("run_id")).select("run_id", "event_id", "sequence", "batch", F.col("r.target_event_id").alias("target_event_id")).distinct()


def scope_digests(answers: DataFrame, scope: DataFrame) -> DataFrame:
    """(aid, digest) of the declared scope of each answer, by order-free sums."""
    lanes = scope.select("receipt_id", "event_id").distinct().groupBy("receipt_id").agg(*agg_set_lanes(F.col("event_id")))
    digest = F.sha2(F.concat_ws("\n", F.lit("scope"), *[F.col(f"_lane{i}").cast("string") for i in range(4)]), 256)
    return answers.where("scope_declared").join(lanes, "receipt_id", "left").select(F.col("receipt_id").alias("aid"), digest.alias("digest"))


def changed_scopes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Answers that were known and now declare another scope."""
    old = before.select("aid", F.col("digest").alias("_old"))
    return now.join(old, "aid").where("digest <> _old").select("aid", F.lit("ANSWER_SCOPE_CHANGE").alias("cause"), F.col("aid").alias("input_id"), F.lit(None).cast("string").alias("invalidated_id"))


def invalidation_log(events: DataFrame, answers: DataFrame, scope: DataFrame) -> DataFrame:
    """The log of all batches at once: the batch twin of what ``IncrementalAnalysis`` writes.

    ``events`` have their ``batch``; a row of ``scope`` holds from ``from_batch`` on.
    """
    arrival = events.select("run_id", "event_id", "sequence", "batch")
    declared = scope.select("receipt_id", "event_id", "from_batch")
    # Frames with a row for each event are never small, whatever their packed file says: joins on them are by shuffles, none holds them in the driver.
    starts = declared.withColumnsRenamed({"receipt_id": "aid"}).distinct()
    with_start = scope_events(arrival, answers, declared).join(starts.hint("merge"), ["aid", "event_id"], "left").withColumn("from_batch", F.coalesce("from_batch", F.lit(0)))
    fresh = with_start.where("from_batch <= batch").select("batch", "aid", F.lit("NEW_INPUT").alias("cause"), F.col("event_id").alias("input_id"), F.lit(None).cast("string").alias("invalidated_id"))
    held = with_start.select("aid", "run_id", "event_id", "from_batch", "batch", "sequence")
    refs = references_of(events).select("run_id", "event_id", "target_event_id").distinct()
    own = refs.join(held.select("aid", "run_id", "event_id", F.col("from_batch").alias("_from"), F.col("batch").alias("_b"), F.col("sequence").alias("_s")).hint("merge"), ["run_id", "event_id"])
    target = held.select("aid", "run_id", F.col("event_id").alias("target_event_id"), "from_batch", "batch", "sequence")
    met = own.join(target.hint("merge"), ["aid", "run_id", "target_event_id"]).where("(_b < batch OR (_b = batch AND _s < sequence)) AND _from <= batch AND from_batch <= batch")
    late = met.select("batch", "aid", F.lit("LATE_REFERENCE").alias("cause"), F.col("target_event_id").alias("input_id"), F.col("event_id").alias("invalidated_id")).distinct()
    last = events.agg(F.max("batch").alias("_last"))
    moved = declared.where("from_batch > 0").join(answers.where("scope_declared").select("receipt_id"), "receipt_id").crossJoin(F.broadcast(last)).where("from_batch <= _last")
    moved = moved.select(F.col("from_batch").alias("batch"), F.col("receipt_id").alias("aid")).distinct().select("batch", "aid", F.lit("ANSWER_SCOPE_CHANGE").alias("cause"), F.col("aid").alias("input_id"), F.lit(None).cast("string").alias("invalidated_id"))
    return fresh.union(late).union(moved)


class IncrementalAnalysis:
    """``foreachBatch`` sink. ``answers`` and ``scope`` give the declarations in force at a batch."""

    def __init__(self, spark: SparkSession, root: str, answers: Callable[[int], DataFrame], scope: Callable[[int], DataFrame], analyzer_version: str = "1", frames: tuple[str, ...] = FRAMES):
        self.spark, self.root, self.answers, self.scope, self.version, self.frames = spark, root, answers, scope, analyzer_version, frames

    # Tables

    def _write(self, df: DataFrame, table: str, generation: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={generation}")

    def read(self, table: str, before: int | None = None) -> DataFrame | None:
        """All generations of a table, or those before one; None where there is none."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        df = self.spark.read.parquet(f"{self.root}/{table}")
        return df if before is None else df.where(F.col("batch") < before)

    def store(self, batch: DataFrame, batch_id: int) -> int:
        """Add a batch to bronze and count its rows on the way."""
        seen = Observation(f"new-{batch_id}")
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int")).withColumn("batch", F.lit(batch_id))
        rows = rows.observe(seen, F.count("*").alias("n")).repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.root}/bronze")
        return int(seen.get["n"])

    def events_of(self, runs: DataFrame, upto: int) -> DataFrame:
        """Events of the given runs: only their buckets are read (at most ``BUCKETS`` numbers come to the driver)."""
        buckets = [r[0] for r in runs.select(F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        rows = self.spark.read.parquet(f"{self.root}/bronze").where(F.col("bucket").isin(buckets) & (F.col("batch") <= upto))
        return rows.join(runs.select("run_id").distinct(), "run_id", "left_semi").drop("bucket")

    # Work

    def causes(self, batch_id: int, answers: DataFrame, scope: DataFrame) -> DataFrame:
        bronze = self.spark.read.parquet(f"{self.root}/bronze")
        fresh = bronze.where(F.col("batch") == batch_id)
        found = new_inputs(fresh, answers, scope)
        own = references_of(fresh)
        # a relation whose target came before it waits for nothing
        self._write(own.drop("batch"), "waiting", batch_id)
        waiting = self.read("waiting").where(F.col("batch") <= batch_id)
        found = found.union(late_references(fresh.select("run_id", "event_id", "sequence", "batch"), waiting, answers, scope))
        digests, known = scope_digests(answers, scope), self.read("scopes", batch_id)
        if known is not None:
            last = known.groupBy("aid").agg(F.max_by("digest", "batch").alias("digest"))
            found = found.union(changed_scopes(last, digests))
            digests = digests.join(last.withColumnRenamed("digest", "_old"), "aid", "left").where("_old IS NULL OR digest <> _old").select("aid", "digest")
        self._write(digests, "scopes", batch_id)
        return found

    def recompute(self, touched: DataFrame, generation: int, answers: DataFrame, scope: DataFrame, upto: int) -> int:
        """Write every table of the analysis for the answers ``touched`` (aid); returns how many events were looked at."""
        own = answers.join(touched.select(F.col("aid").alias("receipt_id")).distinct(), "receipt_id", "left_semi")
        events = self.events_of(own.select("run_id"), upto).drop("batch")
        seen = Observation(f"examined-{generation}")
        marks = scope.join(own.select("receipt_id"), "receipt_id", "left_semi")
        scoped = scope_events(events, own, marks)
        self._write(scoped.observe(seen, F.count("*").alias("n")), "scoped", generation)
        scoped = self.spark.read.parquet(f"{self.root}/scoped/batch={generation}")
        analysis = Analysis(scoped, own, marks)
        for name in self.frames:
            self._write(getattr(analysis, name), f"gold/{name}", generation)
        self._write(signatures(scoped, own, self.version), "signatures", generation)
        self._write(own.select(F.col("receipt_id").alias("aid")), "touched", generation)
        return int(seen.get["n"])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        answers, scope = self.answers(batch_id), self.scope(batch_id)
        delta = self.store(batch, batch_id)
        self._write(self.causes(batch_id, answers, scope).select(*INVALIDATION), "invalidations", batch_id)
        touched = self.spark.read.parquet(f"{self.root}/invalidations/batch={batch_id}").select("aid").distinct()
        examined = self.recompute(touched, batch_id, answers, scope, batch_id)
        done = self.spark.read.parquet(f"{self.root}/touched/batch={batch_id}").count()
        row = (examined, delta, done, answers.count() - done)
        self._write(self.spark.createDataFrame([row], "examined bigint, delta bigint, evaluated bigint, reused bigint"), "stats", batch_id)

    # Reading

    def _latest(self, table: str) -> DataFrame:
        last = self.read("touched").groupBy("aid").agg(F.max("batch").alias("batch"))
        return self.read(table).join(last, ["aid", "batch"]).drop("batch")

    def current(self, name: str = "answer_support") -> DataFrame:
        """A table of the analysis for all answers, each from its last generation."""
        return self._latest(f"gold/{name}")

    def freshness(self, upto: int) -> DataFrame:
        """CURRENT, STALE with reasons or MISSING for each declared answer, against the events stored up to a batch."""
        answers, scope = self.answers(upto), self.scope(upto)
        events = self.spark.read.parquet(f"{self.root}/bronze").where(F.col("batch") <= upto).drop("bucket", "batch")
        return freshness_of(self._latest("signatures"), signatures(scope_events(events, answers, scope), answers, self.version))

    def serve(self, upto: int) -> tuple[DataFrame, DataFrame]:
        """The current report of every answer, and what its state was: stale and missing ones are computed first, fresh ones are left alone."""
        answers, scope = self.answers(upto), self.scope(upto)
        state = self.freshness(upto)
        generation = 1 + (self.read("touched").agg(F.max("batch")).first()[0] or 0)
        self._write(state, "served", generation)
        state = self.spark.read.parquet(f"{self.root}/served/batch={generation}")
        stale = state.where("status <> 'CURRENT'").select("aid")
        if not stale.isEmpty():
            self.recompute(stale, generation, answers, scope, upto)
        return self.current(), state
