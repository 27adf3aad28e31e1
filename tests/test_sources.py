"""Published folders and documents of pages as data sources."""

import os

import pytest
from pyspark.sql import functions as F

from folioqc.sources import pages, published


@pytest.fixture(scope="module")
def sources(spark):
    spark.dataSource.register(published.Published)
    return spark


def files(spark, n, what):
    return spark.range(n, numPartitions=3).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.concat(F.lit(what), F.col("id").cast("string")).cast("binary").alias("content"))


def shown(spark, folder):
    return {r.name: bytes(r.content).decode() for r in spark.read.format("published").load(folder).collect()}


def test_a_job_is_published_whole_or_not_at_all(sources, tmp_path):
    spark, folder = sources, str(tmp_path / "out")
    files(spark, 5, "one ").write.format("published").mode("overwrite").save(folder)
    first = {f"f{i}": f"one {i}" for i in range(5)}
    assert shown(spark, folder) == first
    # A task that fails in the middle of its rows.
    bad = files(spark, 5, "two ").withColumn("content", F.when(F.col("name") == "f4", F.raise_error(F.lit("killed")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="killed"):
        bad.write.format("published").mode("overwrite").save(folder)
    assert shown(spark, folder) == first and len(published.entries(folder)) == 1
    kept = [os.path.join(d, f) for d, _, names in os.walk(f"{folder}/_data") for f in names if not f.endswith(".crc")]
    assert sorted(kept) == sorted(p for _, p in published.current(folder))
    with pytest.raises(Exception, match="written twice"):
        files(spark, 2, "x").unionByName(files(spark, 2, "y")).write.format("published").mode("overwrite").save(folder)
    assert shown(spark, folder) == first
    files(spark, 2, "three ").write.format("published").mode("append").save(folder)
    assert shown(spark, folder) == first | {"f0": "three 0", "f1": "three 1"}
    files(spark, 1, "four ").write.format("published").mode("overwrite").save(folder)
    assert shown(spark, folder) == {"f0": "four 0"}


def test_only_files_that_are_asked_for_are_opened(sources, tmp_path):
    spark, folder = sources, str(tmp_path / "out")
    files(spark, 4, "v").write.format("published").mode("overwrite").save(folder)
    for name, path in published.current(folder):
        if name != "f2":
            os.remove(path)
    assert [bytes(r.content) for r in spark.read.format("published").option("names", '["f2", "none"]').load(folder).collect()] == [b"v2"]
    assert spark.read.format("published").load(str(tmp_path / "none")).count() == 0


def fake_reader():
    """Functions of no module, as a session's own are."""

    def count(content):
        return len(content.decode().split("\f"))

    def read(content, page):
        text = content.decode().split("\f")[page]
        if text.startswith("!"):
            raise ValueError("a page that nobody asked for")
        yield from enumerate(text.split("\n"))

    return count, read


def test_only_pages_that_are_asked_for_are_parsed(sources, tmp_path):
    spark = sources
    (tmp_path / "a.txt").write_text("a0\nb0\f!a1\fa2\f!a3")
    (tmp_path / "b.txt").write_text("b0\f!b1")
    (tmp_path / "c.skip").write_text("!")
    spark.dataSource.register(pages.page_source("fake_pages", *fake_reader(), "line_no int, text string", r".*\.txt"))
    load = lambda **options: spark.read.format("fake_pages").options(**options).load(str(tmp_path))
    assert sorted((os.path.basename(r.path), r.page_index, r.line_no, r.text) for r in load(pages="0").collect()) == [("a.txt", 0, 0, "a0"), ("a.txt", 0, 1, "b0"), ("b.txt", 0, 0, "b0")]
    assert sorted(r.text for r in load(pages="0, 2-2,9").where("page_index > 0").collect()) == ["a2"]
    assert sorted(r.text for r in load(pages="0").where("text like '%0'").select("text").collect()) == ["a0", "b0", "b0"]
    assert [r.text for r in load(document="b.txt", pages="0").collect()] == ["b0"] and load(document="none").count() == 0
    with pytest.raises(Exception, match="nobody asked"):
        load().collect()
