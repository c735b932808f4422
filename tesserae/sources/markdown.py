"""Markdown documents with front matter: read, checked, rendered and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import yaml_scalar


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row for each Markdown file but a readme: name and content."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    return files.where(F.lower("name") != "readme.md")


def front_matter(content: Column) -> Column:
    """Map of the scalar keys. A line that is no key, list item or comment continues the value above it."""
    text = F.regexp_replace(F.regexp_replace(content, "^﻿", ""), "\r\n?", "\n")
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    lines = F.filter(F.split(head, "\n"), lambda s: (F.trim(s) != "") & ~s.rlike(r"^\s*(#|-\s)"))
    joined = F.aggregate(
        lines, F.array().cast("array<string>"),
        lambda a, s: F.when(s.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:") | (F.size(a) == 0), F.concat(a, F.array(s))).otherwise(
            F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit(" "), F.trim(s))))
        ),
    )
    pair = lambda s: F.struct(F.regexp_extract(s, r"^([^:]+):", 1), F.trim(F.regexp_extract(s, r"(?s)^[^:]+:(.*)$", 1)))
    return F.map_from_entries(F.transform(joined, pair))


def stray_line(content: Column) -> Column:
    """The first line of the front matter that is no key, no comment, no item of a list begun just above and no
    continuation of a text value; null where there is none."""
    text = F.regexp_replace(F.regexp_replace(content, "^﻿", ""), "\r\n?", "\n")
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    value = lambda s: F.trim(F.regexp_extract(s, r"^[A-Za-z0-9_]+\s*:\s*(.*)$", 1))

    def step(a: Column, s: Column) -> Column:
        kind = F.when(value(s) == "", "list").when(value(s).isin("null", "~", "true", "false"), "other").otherwise("text")
        is_key, is_item = s.rlike(r"^[A-Za-z0-9_]+\s*:"), s.rlike(r"^\s*-")
        item = is_item & s.rlike(r"^\s+-\s+") & (a["kind"] == "list")
        goes_on = ~is_item & (a["kind"] == "text")
        idle = (F.trim(s) == "") | s.rlike(r"^\s*#")
        after = F.when(idle, F.when(a["kind"] == "list", "other").otherwise(a["kind"])).when(is_key, kind).otherwise(a["kind"])
        bad = F.coalesce(a["bad"], F.when(~(idle | is_key | item | goes_on), s))
        return F.struct(after.alias("kind"), bad.alias("bad"))

    start = F.struct(F.lit("other").alias("kind"), F.lit(None).cast("string").alias("bad"))
    return F.aggregate(F.split(head, "\n"), start, step, lambda a: a["bad"])


def scalar(value: Column) -> Column:
    """A front-matter value as text: no quotes, null for ``null``."""
    inner = F.regexp_extract(value, r'(?s)^"(.*)"$', 1)
    plain = F.replace(F.replace(F.replace(inner, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(value == "null", F.lit(None)).when(value.rlike(r'(?s)^".*"$'), plain).otherwise(value)


def list_values(content: Column, key: str) -> Column:
    """The items of a list in the front matter."""
    block = F.regexp_extract(F.regexp_replace(content, "\r\n?", "\n"), rf"(?m)^{key}:[ \t]*\n((?:[ \t]*- .*\n?)+)", 1)
    return F.transform(F.filter(F.split(block, "\n"), lambda s: F.trim(s) != ""), lambda s: scalar(F.trim(F.regexp_replace(s, r"^\s*-\s", ""))))


def body(content: Column) -> Column:
    """The text without front matter, its heading and the line ends around it; U+3000 stays."""
    text = F.regexp_replace(F.regexp_replace(content, "^﻿", ""), "\r\n?", "\n")
    rest = F.regexp_replace(text, r"(?s)^---\n.*?\n---(?:\n|$)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^\n+", ""), r"^# [^\n]*\n*", ""), r"\n+$", "")


def parsed(files: DataFrame, required: tuple[str, ...] = ("id", "title", "source")) -> DataFrame:
    """Adds fields (map), text, sha256 and error (the first required key that is missing, or ``empty_text``)."""
    own = files.withColumn("_m", front_matter(F.col("content"))).withColumn("fields", F.transform_values("_m", lambda k, v: scalar(v))).drop("_m")
    own = own.withColumn("text", body(F.col("content"))).withColumn("sha256", F.sha2("text", 256))
    missing = [F.when(F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit("")) == "", f"missing_{k}") for k in required]
    return own.withColumn("error", F.coalesce(*missing, F.when(F.col("text") == "", "empty_text")))


def rendered(title: Column, text: Column, scalars: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """A document as Markdown: keys in order, lists, heading and text. Null and empty values are left out."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), yaml_scalar(v))) for k, v in scalars.items()]
    for k, v in (lists or {}).items():
        items = F.transform(v, lambda x: F.concat(F.lit("  - "), yaml_scalar(x)))
        lines.append(F.when(F.size(v) > 0, F.concat(F.lit(f"{k}:\n"), F.array_join(items, "\n"))))
    head = F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))
    return F.concat(head, F.lit("\n\n# "), title, F.lit("\n\n"), text, F.lit("\n"))


def write_chunks(chunks: DataFrame, path: str, by: str, dropped: DataFrame | None = None) -> int:
    """One folder of JSON lines for each document; only those of the given rows are replaced.

    Then the folders of the ids in ``dropped`` go that are still there; others are not looked at. Returns how many.
    """
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)
    if dropped is None:
        return 0
    spark = chunks.sparkSession
    jvm = spark.sparkContext._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for row in dropped.select(F.col(by).cast("string")).where(F.col(by).isNotNull()).distinct().toLocalIterator():
        gone += bool(files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={escape(row[0])}"), True))
    return gone
