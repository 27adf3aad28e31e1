"""Streams of jobs: failures, repeats, restarts, states, retention and progress."""

import json
import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from folioqc.sources import files
from folioqc.streaming import intake

AT = "2024-05-01T10:00:{:02d}Z"


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}.tmp", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.rename(f"{folder}/.{name}.tmp", f"{folder}/{name}")


def job(n, pair="a", session="s"):
    return {"session": session, "job_id": n, "pdf": f"{pair}.pdf", "pptx": f"{pair}.pptx", "size": 1, "modified": 2, "submitted": AT.format(n)}


def run(spark, folder, work):
    q = intake.run_jobs(intake.submissions(spark, f"{folder}/in"), work, f"{folder}/out", f"{folder}/cp")
    q.awaitTermination(120)
    return q


def states(spark, folder):
    return {r.job_id: r.state for r in intake.latest_states(spark.read.parquet(f"{folder}/out/events")).collect()}


def checked(job_id):
    return F.when(F.col(job_id) == 4, F.raise_error(F.lit("this deck is damaged"))).otherwise(F.concat(F.lit("done "), F.col(job_id).cast("string")))


def test_bad_job_fails_alone_and_a_restart_repeats_nothing(spark, tmp_path):
    work = lambda df: df.select("job_id", checked("job_id").alias("out"))
    put(f"{tmp_path}/in", "1.json", [job(n) for n in range(1, 8)])
    put(f"{tmp_path}/in", "2.json", [job(8)])
    assert run(spark, tmp_path, work).exception() is None
    want = {n: "failed" if n == 4 else "completed" for n in range(1, 9)}
    assert states(spark, tmp_path) == want
    failed = spark.read.parquet(f"{tmp_path}/out/events").where("state = 'failed'").collect()
    assert [r.job_id for r in failed] == [4] and failed[0].error
    results = lambda: sorted((r.job_id, r.out) for r in spark.read.parquet(f"{tmp_path}/out/results").collect())
    assert results() == [(n, f"done {n}") for n in range(1, 9) if n != 4]
    # The last batch ends before its commit is known: it runs again over what it left.
    commits = sorted(f for f in os.listdir(f"{tmp_path}/cp/commits") if f.isdigit())
    for f in os.listdir(f"{tmp_path}/cp/commits"):
        if f.strip(".").split(".")[0] == commits[-1]:
            os.remove(f"{tmp_path}/cp/commits/{f}")
    put(f"{tmp_path}/in", "3.json", [job(9)])
    run(spark, tmp_path, work)
    assert states(spark, tmp_path) == want | {9: "completed"}
    assert results() == [(n, f"done {n}") for n in range(1, 10) if n != 4]
    assert spark.read.parquet(f"{tmp_path}/out/events").groupBy("job_id", "state").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("bad", [[], [0], [3, 4], list(range(7))])
def test_failing_jobs_are_found_by_halves(spark, bad):
    jobs, put_rows, calls = spark.range(7).select(F.col("id").alias("job_id")), {}, []

    def work(df):
        ids = [r.job_id for r in df.collect()]
        calls.append(ids)
        if set(ids) & set(bad):
            raise RuntimeError("bad\nin two lines")
        return df

    errors = intake.isolated(jobs, work, lambda rows, part: put_rows.update({part: [r.job_id for r in rows.collect()]}))
    assert {k for k, e in errors.items() if e} == set(bad) and set(errors) == set(range(7))
    assert sorted(i for ids in put_rows.values() for i in ids) == [i for i in range(7) if i not in bad]
    assert all(e == "RuntimeError: bad" for e in errors.values() if e) and len(calls) <= 13


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def collected(spark, df, folder, done, wait=90):
    """Rows of a stateful query once done(rows); such a query has timers and so never ends by itself."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    q = df.writeStream.format("memory").queryName(f"rows_{id(df)}").option("checkpointLocation", f"{folder}/cp").trigger(processingTime="100 milliseconds").start()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        end = time.time() + wait
        while time.time() < end and q.exception() is None:
            rows = spark.table(f"rows_{id(df)}").collect()
            if done(rows):
                return rows
            time.sleep(0.3)
        raise AssertionError((q.exception(), rows))
    finally:
        q.stop()


def test_guard_knows_the_last_completed_pair_only(spark, tmp_path):
    schema = "session string, job_id long, fingerprint string, kind string, at timestamp"
    told = lambda n, pair, kind, session="s": {"session": session, "job_id": n, "fingerprint": pair, "kind": kind, "at": AT.format(n)}
    put(f"{tmp_path}/in", "1.json", [told(1, "A", "submitted"), told(2, "A", "submitted"), told(2, "A", "completed", "other")])
    put(f"{tmp_path}/in", "2.json", [told(3, "A", "completed"), told(4, "A", "submitted"), told(5, "B", "submitted")])
    # In a batch of its own, so that what it knows comes from the state.
    put(f"{tmp_path}/in", "3.json", [told(6, "A", "submitted"), told(7, "B", "completed"), told(8, "A", "submitted"), told(9, "B", "submitted"), told(9, "A", "submitted", "other")])
    got = {(r.session, r.job_id, r.fingerprint): r.repeated for r in collected(spark, intake.guarded(stream_of(spark, f"{tmp_path}/in", schema)), tmp_path, lambda rows: len(rows) == 8)}
    s = {(j, p): r for (session, j, p), r in got.items() if session == "s"}
    assert s == {(1, "A"): False, (2, "A"): False, (4, "A"): True, (5, "B"): False, (6, "A"): True, (8, "A"): False, (9, "B"): True}
    assert got[("other", 9, "A")] is True


def test_ledger_takes_legal_steps_once(spark, tmp_path):
    e = lambda j, seq, state: {"job_id": j, "seq": seq, "state": state}
    put(f"{tmp_path}/in", "1.json", [e(1, 1, "processing"), e(1, 0, "queued"), e(2, 0, "completed"), e(3, 0, "queued")])
    put(f"{tmp_path}/in", "2.json", [e(1, 1, "processing"), e(1, 2, "completed"), e(2, 1, "queued"), e(3, 1, "failed"), e(3, 2, "processing")])
    time.sleep(0.2)
    put(f"{tmp_path}/in", "3.json", [e(4, 0, "queued")])
    rows = collected(spark, intake.ledger(stream_of(spark, f"{tmp_path}/in", intake.EVENT), remembered=1), tmp_path, lambda rows: len(rows) == 11)
    steps = {j: [(r.seq, r.state, r.legal) for r in sorted(rows, key=lambda r: (r.seq, r.state)) if r.job_id == j] for j in (1, 2, 3, 4)}
    assert [s for s in steps[1] if s[1] != "expired"] == [(0, "queued", True), (1, "processing", True), (2, "completed", True)]
    assert steps[2] == [(0, "completed", False), (1, "queued", True)]
    assert [s for s in steps[3] if s[1] != "expired"] == [(0, "queued", True), (1, "failed", True), (2, "processing", False)]
    assert steps[4] == [(0, "queued", True)]
    assert (2, "expired", True) in steps[1] and (2, "expired", True) in steps[3]


def test_old_runs_are_deleted_and_young_ones_stay(spark, tmp_path):
    now = datetime.now(timezone.utc)
    for name, age in (("old", 30), ("older", 50), ("young", 2), ("revived", 40)):
        os.makedirs(tmp_path / "runs" / name / "output")
        (tmp_path / "runs" / name / "output" / "deck.pptx").write_text("x")
        stamp = (now - timedelta(hours=age)).timestamp()
        os.utime(tmp_path / "runs" / name, (stamp, stamp))
    (tmp_path / "runs" / "a file").write_text("x")
    listed = files.run_folders(spark, f"file://{tmp_path}/runs")
    assert {os.path.basename(r.path) for r in listed.collect()} == {"old", "older", "young", "revived"}
    listed = spark.createDataFrame(listed.collect())
    os.utime(tmp_path / "runs" / "revived")
    got = {os.path.basename(r.path): r.outcome for r in files.delete_expired(listed, 24, now).collect()}
    assert got == {"old": "deleted", "older": "deleted", "revived": "kept"}
    assert sorted(os.listdir(tmp_path / "runs")) == ["a file", "revived", "young"]
    assert {r.outcome for r in files.delete_expired(listed.where(F.col("path").rlike("/olde?r?$")), 24, now).collect()} == {"gone"}


def test_every_batch_leaves_a_row_of_progress(spark, tmp_path):
    listener = intake.ProgressLog(f"file://{tmp_path}/progress")
    spark.streams.addListener(listener)
    try:
        put(f"{tmp_path}/in", "1.json", [job(n) for n in range(5)])
        put(f"{tmp_path}/in", "2.json", [job(n) for n in range(5, 8)])
        q = run(spark, tmp_path, lambda df: df.select("job_id"))
        for _ in range(100):
            rows = [r for r in intake.progress_rows(spark, f"{tmp_path}/progress").collect() if r.query == str(q.id)]
            if any(r.kind == "ended" for r in rows):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert {r.kind for r in rows} == {"started", "progress", "ended"}
    assert {r.batch: r.rows for r in rows if r.kind == "progress" and r.rows} == {0: 5, 1: 3}
