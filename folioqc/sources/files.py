"""Listings, environment files, manifests and simple sinks."""

from __future__ import annotations

import os
import re
import uuid
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioqc.functions import text as X


def image_listing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Non-empty PNG files of each folder in natural order, numbered from 0."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", str(recursive).lower()).load(path)
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.regexp_extract("path", "([^/]*)$", 1)
    listed = in_natural_order(files.where("length > 0").select("path", "length", folder.alias("folder"), name.alias("name")))
    return listed.withColumn("page_index", F.col("place") - 1).drop("place")


def in_natural_order(names: DataFrame) -> DataFrame:
    """names (folder, name) with their place in their folder, from 1, numbers in names counting as such."""
    return names.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy(X.natural_key(F.col("name")), "name")))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, length of uploads, with those of other kinds marked unsupported."""
    return spark.read.format("binaryFile").load(path).select("path", X.file_kind(F.col("path")).alias("kind"), "length", "modificationTime")


def accepted(files: DataFrame) -> DataFrame:
    """job_id, error of each job's choice of files (job_id, ord, name): null for one PDF and one PPTX."""
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("ord", X.file_kind(F.col("name")).alias("kind")))), lambda k: k["kind"])
    return files.groupBy("job_id").agg(kinds.alias("kinds")).select("job_id", X.chosen_pair(F.col("kinds")).alias("error"))


def job_copies(files: DataFrame, folder: str) -> DataFrame:
    """source, target of each file of accepted jobs (job_id, name, path): the job's own folder."""
    return files.select(F.col("path").alias("source"), F.concat(F.lit(f"{folder}/"), F.col("job_id").cast("string"), F.lit("/"), F.regexp_replace("name", "^.*/", "")).alias("target"))


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri) if ":" in uri else f"file://{os.path.abspath(uri)}")


def _put(data: bytes, target: str) -> None:
    """Write beside the target and move into place: readers see the old file or the whole new one."""
    store, path = store_of(target)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        out.write(data)
    store.move(temporary, path)


def write_files(files: DataFrame) -> None:
    """Write each row's content to its target, on the executors. A repeated task writes the same again."""

    def run(rows) -> None:
        for r in rows:
            _put(bytes(r.content), r.target)

    files.select("target", "content").foreachPartition(run)


def copy_files(copies: DataFrame) -> None:
    """Copy each source to its target (job_copies), on the executors."""

    def run(rows) -> None:
        for r in rows:
            store, path = store_of(r.source)
            with store.open_input_file(path) as f:
                _put(f.read(), r.target)

    copies.select("source", "target").foreachPartition(run)


def run_folders(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime of the folders of a root, as listed on an executor."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = store_of(uri)
                found = [i for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.type == fs.FileType.Directory]
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{uri.rstrip('/')}/{i.base_name}" for i in part], pa.string()), pa.array([i.mtime for i in part], pa.timestamp("us", "UTC"))], ["path", "modificationTime"])

    return spark.createDataFrame([(root,)], "uri string").mapInArrow(run, "path string, modificationTime timestamp")


def delete_expired(folders: DataFrame, hours: int = 24, now: datetime | None = None) -> DataFrame:
    """path, outcome of folders that are listed as expired: each is looked at again where it is
    deleted, so one that came to life after the listing stays (kept); one that is gone is gone, and
    one that cannot be deleted is told (failed) and left to the next run. An action deletes."""
    cutoff = (now or datetime.now(timezone.utc)) - timedelta(hours=hours)

    def outcome(uri: str) -> str:
        store, path = store_of(uri)
        info = store.get_file_info(path)
        if info.type != fs.FileType.Directory:
            return "gone"
        if info.mtime >= cutoff:
            return "kept"
        try:
            store.delete_dir(path)
        except OSError:
            return "gone" if store.get_file_info(path).type == fs.FileType.NotFound else "failed"
        return "deleted"

    def run(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(outcome, paths), pa.string())], ["path", "outcome"])

    return expired(folders, hours, F.lit(now) if now else None).select("path").mapInArrow(run, "path string, outcome string")


def expired(files: DataFrame, hours: int = 24, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return files.where(F.col("modificationTime") < now - F.expr(f"INTERVAL {hours} HOURS"))


def env_pairs(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, key, value of an environment file's lines (keys, n, value): comments and lines without
    a name are left out, `export` and quotes taken off, and the last of equal names wins."""
    keys = keys or []
    raw = lines.select(*keys, "n", F.regexp_replace(F.trim("value"), "^export\\s+", "").alias("line"))
    pairs = raw.where("line <> '' and not startswith(line, '#') and contains(line, '=')")
    key, value = F.trim(F.regexp_extract("line", "^([^=]*)=", 1)), F.trim(F.regexp_extract("line", "^[^=]*=(.*)$", 1))
    quoted = value.rlike("^(\"[^\"]*\"|'[^']*')$")
    plain = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(F.trim(F.regexp_replace(value, " #.*$", "")))
    return pairs.select(*keys, "n", key.alias("key"), plain.alias("value")).where("key <> ''").groupBy(*keys, "key").agg(F.max_by("value", "n").alias("value"))


def env_file(spark: SparkSession, path: str) -> DataFrame:
    return env_pairs(spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), "value"))


def manifest_lines(actions: DataFrame) -> DataFrame:
    """job_id, ord, line: an action as tab-separated text; actions have job_id, ord, action, page_index, image."""
    after = F.when(F.col("action") == "INSERT", F.col("page_index").cast("string")).otherwise("")
    return actions.select("job_id", "ord", F.concat_ws("\t", "action", after, "image").alias("line"))


def manifest_json(actions: DataFrame) -> DataFrame:
    """job_id, json: all actions of a job, in order."""
    item = F.struct("ord", F.lower("action").alias("kind"), F.when(F.col("action") == "INSERT", F.col("page_index")).alias("insertAfter"), F.col("image").alias("imagePath"))
    listed = F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("ord"))
    return actions.groupBy("job_id").agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("json"))


def manifest_actions(lines: DataFrame) -> DataFrame:
    """job_id, ord, action, page_index, image of manifest lines."""
    p = F.split("line", "\t")
    return lines.select("job_id", "ord", p[0].alias("action"), p[1].try_cast("int").alias("page_index"), p[2].alias("image"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="action string, page_index int, image string")


def write_manifest(actions: DataFrame, path: str) -> None:
    actions.orderBy("ord").drop("ord").coalesce(1).write.mode("overwrite").csv(path, sep="\t")
