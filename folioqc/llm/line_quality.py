"""Quality rules with cross-document line frequency. DataFrame functions only.

Lines are normalised (lower case, white space collapsed) and hashed; for each host (the source
column) the number of distinct documents that hold a line is counted. Lines in more documents of
their host than a limit are boilerplate and are removed; a document of which too little is left is
depleted and rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioqc.llm.common import BROADCAST_ROWS, cut, let, meet, packed, scratch

WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A line is boilerplate in a host when more distinct documents of the host hold it, however large the host is.
LINE_LIMIT = 20
#: A document that lost lines is depleted when fewer words than MIN_WORDS, or than this share, are left.
LEFT_SHARE = 0.5
#: Narrow rows whose memory a text's list of heavy lines takes.
MARK_ROWS = 4


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _text_key() -> Column:
    return F.xxhash64(_text(), F.length(_text()))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def repeated_words(text: Column) -> Column:
    """Words that lie in 3-word windows found twice or more, the first included.

    Windows are hashed; only texts with a repeated window sort them with their positions.
    """

    def covered(windows: Column) -> Column:
        order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def hit(pairs: Column) -> Column:
            twice = F.filter(
                F.transform(
                    pairs,
                    lambda p, i: F.when((F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"]), p["i"]),
                ),
                lambda i: i.isNotNull(),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(order, hit))

    def windows(listed: Column) -> Column:
        return F.when(
            F.size(listed) >= 3,
            let(
                F.transform(F.sequence(F.lit(0), F.size(listed) - 3), lambda i: F.xxhash64(F.get(listed, i), F.get(listed, i + 1), F.get(listed, i + 2))),
                covered,
            ),
        ).otherwise(F.lit(0))

    return let(words(text), windows).cast("bigint")


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), GAP, " "))


def base_rules(rows: DataFrame) -> DataFrame:
    """rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = _text()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return (
        rows.withColumn("n_words", word_count(text))
        .withColumn("word_chars", F.length(F.regexp_replace(text, GAP, "")).cast("bigint"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
        .withColumn("n_repeat_words", repeated_words(text))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    )


def host_lines(rows: DataFrame) -> DataFrame:
    """host, text_key, doc and lines (distinct hashes) of each row. A document is its identifier;
    rows without one are told apart by their text."""
    hashed = F.array_distinct(F.transform(F.filter(F.split(_text(), "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(normal_line(x))))
    none = F.col("doc_id").isNull()
    doc = F.struct(none.alias("none"), F.col("doc_id").alias("id"), F.when(none, _text_key()).alias("other"))
    return rows.select("host", _text_key().alias("text_key"), doc.alias("doc"), hashed.alias("lines"))


def one_of_text(listed: DataFrame) -> DataFrame:
    """host_lines with one document for all rows of a text: its smallest identifier."""
    return listed.groupBy("host", "text_key").agg(F.min("doc").alias("doc"), F.first("lines").alias("lines"))


def boilerplate(listed: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """host, line (hash) and first document of lines that more than limit distinct documents of their
    host hold.

    Rows are counted first, summed before the shuffle; only lines of enough rows have their
    documents told apart, in two steps whose first deals a line's documents to all tasks.
    """
    single = listed.select("host", "doc", F.explode("lines").alias("line"))
    often = cut(single.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("host", "line"), "often")
    exact = meet(single, often, ["host", "line"]).groupBy("host", "line").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("first"))
    return exact.where(F.col("n") > limit).select("host", "line", "first")


def heavy_lines(listed: DataFrame, heavy: DataFrame, spare_first: bool = False) -> DataFrame:
    """host, text_key, heavy: the boilerplate lines of each text that has any; with spare_first, but
    for lines whose first document it is."""
    texts = listed if spare_first else listed.dropDuplicates(["host", "text_key"])
    lines = meet(texts.select("host", "text_key", "doc", F.explode("lines").alias("line")), heavy, ["host", "line"])
    if spare_first:
        lines = lines.where("doc <> first")
    return lines.groupBy("host", "text_key").agg(F.collect_set("line").alias("heavy"))


def verdicts(docs: DataFrame, limit: int = LINE_LIMIT, left_share: float = LEFT_SHARE, by_text: bool = False) -> DataFrame:
    """row (each row of docs as a struct), doc_id, the base columns, clean_text (without boilerplate
    lines), n_removed_lines, n_words_left and kept.

    A null text is empty and fails the base rules; null and empty sources are one host. Each row is
    judged on its own, so repeated rows get the same verdict and count as one document; rows of one
    identifier are one document, rows without any are one for each text. No row gives no row.
    Columns of docs may have any names, as they stay inside `row`. Very long texts and lines are
    read whole. Boilerplate is a table of (host, line) rows: it meets the lines' hashes, and a row
    gets only the heavy lines of its own text, so no limit bounds what a row carries.

    by_text is for rows that hold copies still: equal texts count as one document, and a line stays
    in the first document of its host that has it. So a text that very many rows hold is no
    boilerplate, and of texts that are nearly the same one keeps its lines.
    """
    rows = packed(docs, F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), "text")
    with scratch() as keep:
        listed = host_lines(rows)
        listed = cut(one_of_text(listed) if by_text else listed, "host-lines")
        heavy = cut(boilerplate(listed, limit), "boilerplate")
        marks = keep(cut(heavy_lines(listed, heavy, by_text), "heavy-lines"))
    judged = meet(base_rules(rows).withColumn("text_key", _text_key()), marks, ["host", "text_key"], "left", BROADCAST_ROWS // MARK_ROWS)
    lines = F.split(_text(), "\n")
    rest = F.filter(lines, lambda x: ~F.array_contains(F.col("heavy"), F.xxhash64(normal_line(x))) | ~x.rlike(WORD))
    judged = judged.withColumn("rest", F.when(F.col("heavy").isNotNull(), rest))
    judged = judged.withColumn("clean_text", F.when(F.col("heavy").isNull(), _text()).otherwise(F.array_join("rest", "\n")))
    judged = judged.withColumn("n_removed_lines", F.when(F.col("heavy").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("rest")).cast("bigint"))
    judged = judged.withColumn("n_words_left", F.when(F.col("heavy").isNull(), F.col("n_words")).otherwise(word_count(F.col("clean_text"))))
    depleted = (F.col("n_removed_lines") > 0) & ((F.col("n_words_left") < MIN_WORDS) | (F.col("n_words_left") < F.col("n_words") * left_share))
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("host", "text", "text_key", "heavy", "rest")
