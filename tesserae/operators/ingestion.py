"""Documents to chunks with invariants: what breaks one fails the job and leaves the written tables as they were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import numbered_id
from tesserae.operators.corpus import repeated_ids, with_keywords, without
from tesserae.operators.index import ChunkIndex
from tesserae.sources import markdown


class IngestionError(ValueError):
    """A corpus that breaks an invariant."""


def only(rows: DataFrame, reason: Column) -> DataFrame:
    """The same rows; the first one for which ``reason`` is not null fails the job with it."""
    return rows.where(F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean")))


def document_error(id_col: str, text: str, sha: str | None = None, required: tuple[str, ...] = ()) -> Column:
    """Why a row is no document: ``missing <column>``, ``empty text`` or ``sha256 differs``, with its id; else null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    whose = F.concat(F.lit(": "), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    found = [F.when(blank(c), F.concat(F.lit(f"missing {c}"), whose)) for c in (id_col, *required)]
    found.append(F.when(blank(text), F.concat(F.lit("empty text"), whose)))
    if sha:
        found.append(F.when(~blank(sha) & (F.sha2(text, 256) != F.col(sha)), F.concat(F.lit("sha256 differs"), whose)))
    return F.coalesce(*found)


def assert_unique(rows: DataFrame, id_col: str, what: str) -> None:
    """Raise for the smallest id that is there more than once."""
    first = repeated_ids(rows, id_col).agg(F.min(id_col)).first()[0]
    if first is not None:
        raise IngestionError(f"repeated {what}: {first}")


def chunked(docs: DataFrame, id_col: str, text: str, pieces: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each piece, with chunk_id, chunk_index and chunk_text, each checked against the text it is cut from.

    A document without a piece, and a piece that does not stand in its text as it is, fail the job. Both are decided
    in the document's row, before pieces become rows, so the text is neither copied nor joined.
    """
    whose = F.col(id_col).cast("string")
    own = docs.withColumn("_pieces", pieces)
    changed = F.exists("_pieces", lambda p: ~F.contains(F.col(text), p))
    reason = F.when(F.size("_pieces") <= 0, F.concat(F.lit("no chunk: "), whose)).when(changed, F.concat(F.lit("chunk is no substring: "), whose))
    rows = only(own, reason).select(id_col, *keep, F.posexplode("_pieces").alias("chunk_index", "chunk_text"))
    return rows.withColumn("chunk_id", numbered_id(whose, F.col("chunk_index"), "_chunk_"))


def documents_of_folder(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents of a folder of Markdown files; no folder, no file in it, and files with an error fail."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise IngestionError(f"no folder: {path}")
    files = markdown.read_folder(spark, path)
    if not files.take(1):
        raise IngestionError(f"no Markdown in the folder: {path}")
    own = markdown.parsed(files.withColumn("_stray", markdown.stray_line(F.col("content"))), required=())
    field = lambda *names: F.coalesce(*(F.nullif(F.try_element_at("fields", F.lit(n)), F.lit("")) for n in names))
    lists = [markdown.list_values(F.col("content"), k) for k in ("retrieval_keywords", "keywords")]
    head = F.when(~F.col("content").rlike("^﻿?---\r?\n(?s).*?\r?\n---(\r?\n|$)"), "no front matter").when(F.col("_stray").isNotNull(), F.concat(F.lit("no front matter line: "), F.col("_stray")))
    own = only(own, F.concat(F.col("name"), F.lit(": "), head))
    return own.select(
        field("speechId", "id").alias("id"), field("title").alias("title"), field("source").alias("source"), field("date").alias("date"),
        field("url").alias("url"), field("sha256").alias("sha256"), "text", F.when(F.size(lists[0]) > 0, lists[0]).otherwise(lists[1]).alias("keywords"),
    )


def ingest(
    docs: DataFrame, path: str, pieces: Column, id_col: str = "id", text: str = "text", sha: str | None = "sha256", required: tuple[str, ...] = ("title", "source"),
    dropped: DataFrame | None = None, tags: DataFrame | None = None, keep: tuple[str, ...] = ("keywords",),
) -> dict[str, int]:
    """Check documents, cut them into chunks and write both under ``path``; returns what was counted on the way.

    Ids of ``dropped`` are left out first; ``tags`` gives keywords to documents without. Broken documents, repeated
    ids of documents or chunks, documents without chunks and chunks that are no substring raise an error, and the
    tables stay as they were before: each is written beside the old one, checked by reading its ids, and then named.
    Counts are observed while rows are written, so nothing is read twice for them.
    """
    spark = docs.sparkSession
    own = without(docs, dropped, id_col) if dropped is not None else docs
    own = with_keywords(own, tags, id_col) if tags is not None else own
    own = only(own, document_error(id_col, text, sha, required))
    counts, cuts = Observation(), Observation()
    verified = F.count_if(F.sha2(text, 256) == F.col(sha)) if sha else F.lit(0)
    seen = own.observe(counts, F.count("*").alias("documents"), F.coalesce(verified, F.lit(0)).alias("verified"))
    tables = {n: ChunkIndex(spark, f"{path}/{n}") for n in ("documents", "chunks")}

    def unique(column: str, what: str):
        def check(staged: DataFrame) -> str | None:
            first = repeated_ids(staged, column).agg(F.min(column)).first()[0]
            return f"repeated {what}: {first}" if first is not None else None

        return check

    try:
        old = tables["documents"].version()
        tables["documents"].replace(seen, check=unique(id_col, "document id"))
        chunks = chunked(tables["documents"].read(), id_col, text, pieces, keep)
        try:
            tables["chunks"].replace(chunks.observe(cuts, F.count("*").alias("chunks")), check=unique("chunk_id", "chunk id"))
        except Exception:
            tables["documents"].restore(old)
            raise
    except Exception as error:
        raise IngestionError(str(error)) from error
    return {**counts.get, **cuts.get}


def preflight_report(docs: DataFrame, pieces: Column, id_col: str, text: str, sha: str, dropped: DataFrame) -> DataFrame:
    """One row of counts, without failing: documents, verified (hashes that fit), unique_ids, runtime_documents and
    runtime_chunks (without those of ``dropped``), chunks, substrings (chunks that stand in their text), unique_chunk_ids
    and dropped. Each text is read once, in its own row; only ids are shuffled."""
    gone = dropped.select(F.col(id_col).alias("_gone")).distinct()
    parts = F.coalesce(pieces, F.array().cast("array<string>"))
    own = docs.select(
        F.col(id_col).alias("_id"), F.size(parts).alias("_n"), (F.sha2(text, 256) == F.col(sha)).alias("_fits"),
        F.size(F.filter(parts, lambda p: F.contains(F.col(text), p))).alias("_in"),
    ).join(gone, F.col("_id") == F.col("_gone"), "left")
    runs = F.col("_gone").isNull()
    by_id = own.groupBy("_id").agg(
        F.count("*").alias("_d"), F.count_if("_fits").alias("_fits"), F.sum("_n").alias("_n"), F.max("_n").alias("_most"), F.sum("_in").alias("_in"), F.bool_and(runs).alias("_runs")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    some = by_id.agg(
        total("_d").alias("documents"), total("_fits").alias("verified"), F.coalesce(F.max("_d") <= 1, F.lit(True)).alias("unique_ids"),
        total(F.when(F.col("_runs"), F.col("_d"))).alias("runtime_documents"), total("_n").alias("chunks"), total(F.when(F.col("_runs"), F.col("_n"))).alias("runtime_chunks"),
        total("_in").alias("substrings"), F.coalesce(F.bool_and(F.col("_n") == F.col("_most")), F.lit(True)).alias("unique_chunk_ids"),
    )
    return some.join(F.broadcast(gone.agg(F.count("*").alias("dropped"))), how="cross")  # one row with one row
