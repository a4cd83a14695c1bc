"""Result records of jobs: staged batch by batch, and shown by a manifest that is replaced as a whole."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirefold.sources.schemas import OPTION

PROBLEM = f"struct<number: string, question: string, answer: string, options: array<{OPTION}>, analysis: string>"
RECORD = f"job_id string, status string, problem_count int, problems array<{PROBLEM}>"
#: The status of a job that has a result, and what asking for others tells.
COMPLETED = "completed"
UNKNOWN, NOT_COMPLETE, NO_RECORD = "no such job", "job is not complete: ", "the job's result is missing"


#: Writers of one driver take turns; those of others are told apart by the file system, whose rename (as HDFS's) doesn't replace a file.
_TURN = threading.Lock()


class ManifestConflict(RuntimeError):
    """Other writers were faster, again and again."""


def records(problems: DataFrame) -> DataFrame:
    """A record (RECORD) for each job of problems (job_id, problem_seq, number, question, answer, options, analysis), its problems in order. A job with no problem at all has a row whose problem_seq is null."""
    problem = F.struct("number", "question", "answer", "options", "analysis").cast(PROBLEM)
    listed = F.array_sort(F.collect_list(F.when(F.col("problem_seq").isNotNull(), F.struct("problem_seq", problem.alias("p")))))
    rows = problems.groupBy("job_id").agg(listed.alias("ps"))
    return rows.select("job_id", F.lit(COMPLETED).alias("status"), F.size("ps").alias("problem_count"), F.transform("ps", lambda x: x["p"]).alias("problems"))


def as_json() -> Column:
    """A record as the JSON text that a job's caller gets."""
    return F.to_json(F.struct("job_id", "status", "problem_count", "problems"))


@dataclass(frozen=True)
class ResultStore:
    """A folder of records. Batches are Parquet folders; manifest n lists all batches that are shown, in the order of their commits, and the highest n holds.

    A manifest is made by renaming a file to a name that must not exist yet, so of two writers that add to the same manifest one finds it taken, reads it and goes on from
    there. Readers see all of a batch or nothing, whatever tasks, drivers or writers are lost; a batch whose name is listed already is not added again.
    """

    spark: SparkSession
    path: str

    def _file_system(self):  # noqa: ANN202
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return at.getFileSystem(context._jsc.hadoopConfiguration()), at

    def _latest(self) -> int:
        """The number of the last manifest; 0 without any."""
        fs, at = self._file_system()
        if not fs.exists(at):
            return 0
        return max((int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")), default=0)

    def _read(self, number: int) -> list[dict[str, str]]:
        if not number:
            return []
        text = self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).first()
        return json.loads(text["value"])["batches"]

    def _create(self, number: int, batches: list[dict[str, str]]) -> bool:
        """Whether manifest number could be made: not if there is one. It is written aside first and renamed, so none is seen in part."""
        fs, at = self._file_system()
        jvm = self.spark.sparkContext._jvm
        final = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{number:012d}.json")
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.path}/aside/{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"batches": batches}, ensure_ascii=False).encode()))
        out.close()
        fs.mkdirs(at)
        with _TURN:
            done = not fs.exists(final) and fs.rename(aside, final)
        if not done:
            fs.delete(aside, False)
        return bool(done)

    def batches(self) -> list[str]:
        """The names of the batches that are shown, in the order of their commits."""
        return [b["name"] for b in self._read(self._latest())]

    def stage(self, rows: DataFrame) -> str:
        """Write records to a folder of their own, which no reader sees until it is committed."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/batches/{folder}")
        return folder

    def commit(self, name: str, folder: str, attempts: int = 20) -> bool:
        """Show a staged batch under a name; False if that name is shown already, and the staged rows are then removed."""
        for _ in range(attempts):
            number = self._latest()
            shown = self._read(number)
            if any(b["name"] == name for b in shown):
                self.discard(folder)
                return False
            if self._create(number + 1, [*shown, {"name": name, "folder": folder}]):
                return True
        raise ManifestConflict(f"batch {name} could not be shown in {attempts} attempts")

    def discard(self, folder: str) -> None:
        fs, _ = self._file_system()
        fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches/{folder}"), True)

    def write(self, rows: DataFrame, name: str) -> bool:
        """Stage and commit; a name that is shown already isn't even staged, so a replay costs nothing and changes nothing."""
        return name not in self.batches() and self.commit(name, self.stage(rows))

    def read(self) -> DataFrame:
        """The last record of each job, by the order of commits. One read of all shown batches; records of a job meet by a grouping."""
        shown = self._read(self._latest())
        if not shown:
            return self.spark.createDataFrame([], RECORD)
        order = self.spark.createDataFrame([(b["folder"], i) for i, b in enumerate(shown)], "_folder string, _ord int")
        rows = self.spark.read.schema(RECORD).parquet(*[f"{self.path}/batches/{b['folder']}" for b in shown])
        rows = rows.withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), "/batches/([0-9a-f]{32})/", 1)).join(order, "_folder")
        return rows.groupBy("job_id").agg(F.max_by(F.struct("status", "problem_count", "problems"), "_ord").alias("r")).select("job_id", "r.*")

    def ask(self, jobs: DataFrame, states: DataFrame, on_error: str = "tell") -> DataFrame:
        """The records of jobs (job_id, ...), each row of them once, with error for those that have none: unknown to states (job_id, status), not completed, or lost.

        on_error is `tell`, or `fail` to raise the error of any.
        """
        known = states.select(F.col("job_id").alias("_known"), F.col("status").alias("_state"))
        kept = self.read().select(F.col("job_id").alias("_kept"), "problem_count", "problems")
        rows = jobs.join(known, jobs["job_id"] == known["_known"], "left").join(kept, jobs["job_id"] == kept["_kept"], "left")
        error = F.when(F.col("_known").isNull(), UNKNOWN).when(~F.col("_state").eqNullSafe(F.lit(COMPLETED)), F.concat(F.lit(NOT_COMPLETE), F.coalesce("_state", F.lit("")))).when(F.col("_kept").isNull(), NO_RECORD)
        rows = rows.withColumn("error", error)
        if on_error == "fail":
            rows = rows.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat("job_id", F.lit(": "), "error")).cast("boolean")))
        shown = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
        return rows.select(*[jobs[c] for c in jobs.columns], shown("problem_count"), shown("problems"), "error")

    def follow(self, stream: DataFrame, checkpoint: str, name: str, to_records: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StreamingQuery:
        """Write a stream's batches under its name and their numbers: a batch that Spark runs again after a failure is shown once."""
        return stream.writeStream.foreachBatch(lambda rows, n: self.write(to_records(rows), f"{name}-{n}") and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
