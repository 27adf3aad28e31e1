"""Job intake: submissions as a stream, guarded by the session's last completed pair; batches of jobs
whose failures stay their own; states as a log of batches and a ledger that is kept as stream state."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioqc.functions.text import fingerprint, percent_done
from folioqc.sources.files import store_of

SUBMISSION = "session string, job_id long, pdf string, pptx string, size long, modified long, submitted timestamp"
EVENT = "job_id long, seq long, state string, error string"

#: The states that a job may go to from each; a job that is not known yet has none. Fixed values.
LEGAL = {"": ("queued",), "queued": ("processing", "failed"), "processing": ("completed", "failed"), "completed": (), "failed": ()}
FINAL = ("completed", "failed")
#: Milliseconds for which the ledger and the guard remember a job or a pair.
REMEMBERED = 24 * 3600 * 1000
FAILED = "The job failed unexpectedly. Check the server log for details."


def state_store(spark: SparkSession) -> None:
    """Stateful queries need a store with column families and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def submissions(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Submissions of a folder's files, a few files at a time, with the fingerprint of their pair."""
    stream = spark.readStream.schema(SUBMISSION).option("maxFilesPerTrigger", files).json(path)
    return stream.withColumn("fingerprint", fingerprint("pdf", "pptx", "size", "modified"))


# ---- the guard --------------------------------------------------------------------------------


class LastPair(StatefulProcessor):
    """Of one session the fingerprint that was last completed; a submission of that very pair is a
    repeat. Any other pair in between makes it welcome again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fingerprint string", ttlDurationMs=REMEMBERED)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        seen = last
        told = pd.concat(list(rows)).sort_values(["at", "kind", "job_id"], kind="stable")
        out = []
        for r in told.itertuples():
            if r.kind == "completed":
                last = r.fingerprint
            else:
                out.append((key[0], r.job_id, r.fingerprint, r.fingerprint == last))
        if last != seen:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["session", "job_id", "fingerprint", "repeated"]).astype({"repeated": bool})

    def close(self) -> None:
        pass


def guarded(events: DataFrame) -> DataFrame:
    """session, job_id, fingerprint, repeated of each submission in a stream of session, job_id,
    fingerprint, kind (submitted or completed) and at. What the guard knows of a session is state of
    the query, forgotten after REMEMBERED; at one moment a completion comes before a submission.
    Its clock makes the query run batches without data, so trigger it by processing time."""
    state_store(events.sparkSession)
    return events.select("session", "job_id", "fingerprint", "kind", "at").groupBy("session").transformWithStateInPandas(
        LastPair(), "session string, job_id long, fingerprint string, repeated boolean", "append", "ProcessingTime"
    )


# ---- running ----------------------------------------------------------------------------------


def isolated(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], put: Callable[[DataFrame, int], None]) -> dict[int, str | None]:
    """Run work over all jobs of a batch and put its rows; where that fails, over each half of them,
    until the jobs that fail are alone. Returns the error of each job, None for those that ran.

    A batch with one bad job of n runs 2 log n times. put gets rows and the number of the part, which
    is the same at every attempt. The identifiers of a batch (a few files) come to the driver.
    """
    ids = sorted(r.job_id for r in jobs.select("job_id").distinct().collect())
    errors: dict[int, str | None] = {}

    def run(some: list[int], part: int) -> None:
        try:
            put(work(jobs.where(F.col("job_id").isin(some))), part)
        except Exception as problem:  # whatever a job's work raises is that job's failure
            if len(some) == 1:
                errors[some[0]] = f"{type(problem).__name__}: {str(problem).strip().splitlines()[0] if str(problem).strip() else FAILED}"[:500]
                return
            half = len(some) // 2
            run(some[:half], 2 * part)
            run(some[half:], 2 * part + 1)
        else:
            errors.update(dict.fromkeys(some))

    if ids:
        run(ids, 1)
    return errors


def run_jobs(stream: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Run each micro-batch's jobs; states go to folder/events, rows of work to folder/results.

    Both are written under the batch's number, over whatever an attempt that was cut off has left,
    so that a batch which runs again after a restart repeats nothing. A job that fails is failed in
    the log; the other jobs of its batch complete and the stream goes on.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        jobs = df.persist()
        try:
            if jobs.isEmpty():
                return
            ids = jobs.select("job_id").distinct()

            def log(step: int, rows: DataFrame) -> None:
                rows.select("job_id", (F.lit(number).cast("bigint") * 10 + F.col("seq")).alias("seq"), "state", "error").write.mode("overwrite").parquet(f"{folder}/events/batch={number}/step={step}")

            started = F.array(F.struct(F.lit(0).alias("seq"), F.lit("queued").alias("state")), F.struct(F.lit(1).alias("seq"), F.lit("processing").alias("state")))
            log(0, ids.select("job_id", F.inline(started)).withColumn("error", F.lit(None).cast("string")))
            remove(f"{folder}/results/batch={number}")
            errors = isolated(jobs, work, lambda rows, part: rows.write.mode("overwrite").parquet(f"{folder}/results/batch={number}/part={part}"))
            ended = [(job, 2, "completed" if error is None else "failed", error) for job, error in errors.items()]
            log(1, spark.createDataFrame(ended, "job_id long, seq int, state string, error string"))
        finally:
            jobs.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remove(folder: str) -> None:
    store, path = store_of(folder)
    if store.get_file_info(path).type.name == "Directory":
        store.delete_dir(path)


# ---- states -----------------------------------------------------------------------------------


class Ledger(StatefulProcessor):
    """The state of one job. A transition that is not legal is told and changes nothing; an event
    that was heard before is passed over; some time after its end the job expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state, heard = self.now.get() if self.now.exists() else ("", -1)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if r.seq <= heard:
                continue
            heard, legal = r.seq, r.state in LEGAL.get(state, ())
            if legal:
                state = r.state
                if state in FINAL:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.remembered)
            out.append((key[0], r.seq, r.state, legal))
        self.now.update((state, heard))
        yield self.table(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        _, heard = self.now.get()
        self.now.clear()
        yield self.table([(key[0], heard, "expired", True)])

    def __init__(self, remembered: int = REMEMBERED):
        self.remembered = remembered

    @staticmethod
    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["job_id", "seq", "state", "legal"]).astype({"legal": bool})

    def close(self) -> None:
        pass


def ledger(events: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """job_id, seq, state, legal of a stream of events (job_id, seq, state): each event once, with
    whether the job could go there, and `expired` when a job has been over for so many milliseconds,
    after which it is forgotten. A job's state is state of the query: durable, and as large as the
    jobs that are remembered. Its timers make the query run batches without data, so trigger it by
    processing time."""
    state_store(events.sparkSession)
    return events.select("job_id", "seq", "state").groupBy("job_id").transformWithStateInPandas(Ledger(remembered), "job_id long, seq long, state string, legal boolean", "append", "ProcessingTime")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events that run_jobs writes, as a stream."""
    return spark.readStream.schema(f"{EVENT}, batch long, step int").parquet(f"{folder}/events")


def latest_states(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"))


# ---- progress ---------------------------------------------------------------------------------


class ProgressLog(StreamingQueryListener):
    """Writes a row for each micro-batch of the session's queries, a file each, to a folder."""

    def __init__(self, folder: str):
        self.store, self.path = store_of(folder)
        self.store.create_dir(self.path, recursive=True)

    def _put(self, **row: object) -> None:
        name = f"{self.path}/{row['query']}-{row['kind']}-{row.get('batch', 0):012d}-{uuid.uuid4().hex[:8]}.json"
        with self.store.open_output_stream(name) as out:
            out.write((json.dumps(row) + "\n").encode())

    def onQueryStarted(self, event) -> None:
        self._put(query=str(event.id), kind="started", at=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._put(query=str(p.id), kind="progress", at=p.timestamp, batch=p.batchId, rows=p.numInputRows, milliseconds=p.batchDuration)

    def onQueryTerminated(self, event) -> None:
        self._put(query=str(event.id), kind="ended", at="", error=event.exception)


PROGRESS = "query string, kind string, at string, batch long, rows long, milliseconds long, error string"


def progress_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(folder)


def progress(slides: DataFrame, finished: DataFrame) -> DataFrame:
    """job_id, processed, total, percent of jobs, from their slides and the log of finished ones
    (job_id, slide), in which a slide may be named again after a retry."""
    total = slides.groupBy("job_id").agg(F.count("*").alias("total"))
    done = finished.join(slides, ["job_id", "slide"], "left_semi").groupBy("job_id").agg(F.count_distinct("slide").alias("processed"))
    joined = total.join(done, "job_id", "left").withColumn("processed", F.coalesce("processed", F.lit(0)))
    return joined.select("job_id", "processed", "total", percent_done(F.col("processed"), F.col("total")).alias("percent"))


def status_answer(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """job_id, state, ready, answer of a request for a job's file: 404 for an unknown job, 409 until it is ready, else 200."""
    joined = jobs.join(latest_states(events), "job_id", "left")
    ready = F.coalesce(F.col("state") == "completed", F.lit(False))
    return joined.select("job_id", "state", ready.alias("ready"), F.when(F.col("state").isNull(), 404).when(ready, 200).otherwise(409).alias("answer"))


def repeats_last(submissions: DataFrame) -> DataFrame:
    """submissions (session, seq, fingerprint, completed) with repeated: if the pair is the last one
    that the session has completed before. An earlier pair may be given again."""
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("completed"), F.col("fingerprint")), ignorenulls=True).over(before)
    return submissions.withColumn("repeated", F.coalesce(last == F.col("fingerprint"), F.lit(False)))
