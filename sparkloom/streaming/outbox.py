"""Delivery with attempts: a ledger from which each submission is handed over at most once an attempt."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intake import delivery

#: Fixed value: milliseconds after which an answer counts as none.
TIME_OUT = 7000

_CLAIM = "submission_id string, attempt int, mode string, batch long"
_RESULT = "submission_id string, attempt int, http int, millis long, batch long"


@dataclass(frozen=True)
class Outbox:
    """Claims and results of attempts, as tables by batch below ``folder``, which all executors reach.

    A batch first claims what it is to hand over, then hands it over, then
    writes what came back. If it is run again, what it had claimed isn't handed
    over a second time: without a result it counts as unanswered, which ends
    like a time-out. A submission that comes again, in another batch, is a
    further attempt, unless it was delivered before.
    """

    folder: str

    def _table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    def attempts(self, spark: SparkSession) -> DataFrame:
        """``submission_id``, ``attempt``, ``batch``, ``answer`` (ok, refused, late, none) and ``outcome`` of every attempt."""
        claims, results = self._table(spark, "claims", _CLAIM), self._table(spark, "results", _RESULT)
        rows = claims.join(results.drop("batch"), ["submission_id", "attempt"], "left")
        answer = F.when(F.col("http").isNull() & F.col("millis").isNull(), "none").when(F.col("millis") > TIME_OUT, "late").when(F.col("http").between(200, 299), "ok").otherwise("refused")
        return rows.withColumn("answer", answer).select("submission_id", "attempt", "batch", "answer", delivery(F.col("mode"), F.col("answer") == "ok").alias("outcome"))

    def deliver(self, accepted: DataFrame, number: int, mode: Column, send: Callable[[DataFrame], DataFrame]) -> None:
        """Hand over a batch's accepted submissions: ``send`` gets their rows with ``attempt`` and gives ``submission_id``, ``http`` and ``millis``.

        Modes that never call the endpoint claim without handing over. Of a
        submission that is in the batch more than once one row counts.
        """
        accepted = accepted.persist()
        try:
            self._deliver(accepted, number, mode, send)
        finally:
            accepted.unpersist()

    def _deliver(self, accepted: DataFrame, number: int, mode: Column, send: Callable[[DataFrame], DataFrame]) -> None:
        spark = accepted.sparkSession
        claims = self._table(spark, "claims", _CLAIM)
        if not claims.where(F.col("batch") == number).isEmpty():
            return  # run again: nothing is handed over twice
        done = self.attempts(spark)
        before = done.groupBy("submission_id").agg(F.max("attempt").alias("last"), F.max(F.col("answer") == "ok").alias("ok"))
        fresh = accepted.dropDuplicates(["submission_id"]).withColumn("mode", mode).join(before, "submission_id", "left").where(~F.coalesce("ok", F.lit(False)))
        fresh = fresh.withColumn("attempt", F.coalesce(F.col("last") + 1, F.lit(1))).drop("last", "ok")
        fresh.select("submission_id", "attempt", "mode").write.mode("overwrite").parquet(f"{self.folder}/claims/batch={number}")
        own = self._table(spark, "claims", _CLAIM).where((F.col("batch") == number) & F.col("mode").isin("api", "auto"))
        sent = send(accepted.dropDuplicates(["submission_id"]).join(own.select("submission_id", "attempt"), "submission_id"))
        sent.join(own.select("submission_id", "attempt"), "submission_id").select("submission_id", "attempt", F.col("http").cast("int").alias("http"), F.col("millis").cast("long").alias("millis")).write.mode("overwrite").parquet(f"{self.folder}/results/batch={number}")

    def hand_offs(self, spark: SparkSession) -> DataFrame:
        """Submissions whose last attempt ended as a message to hand off, which ``functions.scalars.message`` writes."""
        last = self.attempts(spark).groupBy("submission_id").agg(F.max_by("outcome", "attempt").alias("outcome"), F.max("attempt").alias("attempts"))
        return last.where("outcome = 'handed_off'").select("submission_id", "attempts")
