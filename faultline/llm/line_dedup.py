"""Operator 6: repeated passages, by overlapping windows of three lines.

Windows of consecutive lines are hashed and counted over the whole corpus. Of a window that occurs more than once, the
first occurrence stays; the lines that later occurrences cover are merged per document and removed. All of it is built-in
functions.

A window that occurs once travels as one number and a count. Only windows that may repeat are looked at again, with
their exact digests and places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.llm.common import BLANK, table, text_of, unused
from faultline.sources.shared import materialise

LINES = 3

#: Files of an intermediate table.
FILES_PER_CORE = 4


def _let(value: Column, fn) -> Column:
    return F.transform(F.array(value), fn)[0]


def _identity(key: Column, text: Column) -> Column:
    """Rows with equal key and text are one document here and are treated alike."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), text)))


def line_places(text: Column) -> Column:
    """(at, line) of the lines that are not blank; white space within a line counts as one blank, around it as none."""
    lines = F.transform(
        F.split(text, "\n", -1),
        lambda x, i: F.struct(i.alias("at"), F.trim(F.regexp_replace(x, BLANK, " ")).alias("line")),
    )
    return F.filter(lines, lambda x: x["line"] != "")


def windows(rows: DataFrame) -> DataFrame:
    """(self, key, first, last, digest): one row per window; `first` and `last` are line numbers."""

    def of_places(places: Column) -> Column:
        def window(i: Column) -> Column:
            part = [F.get(places, i + n) for n in range(LINES)]
            digest = F.unhex(F.md5(F.concat_ws("\n", *[p["line"] for p in part])))
            return F.struct(
                part[0]["at"].alias("first"), part[-1]["at"].alias("last"), digest.alias("digest")
            )

        return F.transform(F.sequence(F.lit(0), F.size(places) - LINES), window)

    def enough(places: Column) -> Column:
        return F.when(F.size(places) >= LINES, of_places(places))

    found = rows.select("self", "key", F.explode(_let(line_places(F.col("text")), enough)).alias("w"))
    return found.select("self", "key", "w.*").withColumn("mark", F.xxhash64("digest"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table of a few files per core: these tables are small, and every file costs the file system some calls."""
    return materialise(df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism), name)


def covered_lines(rows: DataFrame) -> DataFrame:
    """(self, covered): the line numbers that later occurrences of repeated windows cover, merged per document."""
    found = windows(rows)
    # A number per window and a count: combined in the tasks, so a passage of a third of all documents is one row each.
    marks = _written(found.groupBy("mark").count().filter("count > 1").select("mark"), "marks")
    members = _written(found.join(marks, "mark", "left_semi").drop("mark").distinct(), "members")
    place = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("self"), F.col("first"))
    repeated = members.groupBy("digest").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Written first: the rows of a passage of a third of all documents can be split only if the other side is a table.
    firsts = _written(repeated.select("digest", "place"), "firsts")
    later = members.join(firsts, "digest").filter(place != F.col("place"))
    # Between the window's lines there may be blank ones; they go with it.
    return later.groupBy("self").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """`docs` with later occurrences of repeated windows removed from the text; all rows and columns stay.

    A window is three consecutive lines that are not blank; texts with fewer have none and stay as they are. "Later" is
    by key (null keys last), then by a digest of the text, then by line. Of every repeated line one copy is left. Rows
    with equal key and text are one document: they are not compared with each other and are cut alike. Null texts stay
    null, empty ones empty; an empty table gives no rows. Columns may have any names; if `n_lines` and `n_removed` are
    given, columns of these names hold the numbers of lines before, and of lines removed.
    """
    whole, own, value = unused(docs, "row", "self", "value")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole),
        _identity(F.col(f"`{key}`"), text_of(text)).alias(own),
    )
    keyed = docs.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text")).withColumn(
        "self", _identity(F.col("key"), F.col("text"))
    )
    spans = covered_lines(keyed).withColumnRenamed("self", own).withColumnRenamed("spans", value)
    joined = rows.join(spans, own, "left")
    old = F.col(whole)[text].cast("string")
    lines = F.split(old, "\n", -1)

    def cut(lines: Column) -> Column:
        covered = F.array_distinct(F.flatten(F.transform(value, lambda s: F.sequence(s["first"], s["last"]))))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        return F.struct(
            F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
            (F.size(lines) - F.size(kept)).cast("long").alias("removed"),
        )

    new = F.when(F.col(value).isNotNull(), _let(lines, cut))
    out = joined.select(
        whole, F.coalesce(new["text"], old).alias(own), F.coalesce(new["removed"], F.lit(0)).alias(value),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(f"{own}_n"),
    )
    columns = [F.col(own).alias(c) if c == text else F.col(whole)[c].alias(c) for c in docs.columns]
    extra = [F.col(c).alias(name) for c, name in ((f"{own}_n", n_lines), (value, n_removed)) if name]
    return out.select(*columns, *extra)


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = remove_repeated(docs, n_lines="n_lines", n_removed="n_removed")
    text = F.coalesce("text", F.lit(""))
    return cut.select(
        "doc_id", F.when(F.col("n_lines") == 0, 1).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_removed",
        F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"),
    )


SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, trim(regexp_replace(ls[i], '{BLANK}', ' ', 'g')) AS line
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
w AS (SELECT doc_id, pos AS lo, lead(pos, 2) OVER o AS hi,
        line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o AS passage
      FROM l WHERE line <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, lo, hi FROM w WHERE passage IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, lo) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM later),
kept AS (SELECT doc_id, ls, list_filter(range(0, len(ls)), lambda x: NOT list_contains(coalesce(ats, []), x)) AS ats
         FROM d LEFT JOIN (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id) USING (doc_id)),
t AS (SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - len(ats))::BIGINT AS n_removed,
        coalesce(array_to_string(list_transform(ats, lambda x: ls[x + 1]), chr(10)), '') AS text FROM kept)
SELECT doc_id, n_lines, n_removed, length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256 FROM t
"""
