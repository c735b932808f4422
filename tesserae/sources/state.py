"""The store's state and its failure log: JSON as it is found, with what cannot be read set apart, and appended records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "url string, keyword string, reason string, timestamp string"


def records(documents: DataFrame, content: str, key: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """The records of JSON documents that are a list or an object with a list under ``key``; a row for each record.

    Columns: the other columns of documents, pos, the fields of ``schema`` and ``quarantine``. That is null for a good
    record, whose fields may be absent but for the ``required`` ones. Else it says why not, with the fields null and
    the record as it was in ``raw``: ``not_json``, ``no_list`` (a whole document each), ``not_an_object``,
    ``missing_<field>`` or ``bad_<field>``, where a value does not fit its type. An object without the list is an
    empty list, as is a null or blank document.
    """
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema).fields}
    rest = [c for c in documents.columns if c != content]
    text = F.trim(F.coalesce(content, F.lit("")))
    v = F.try_parse_json(text)
    shape = F.schema_of_variant(v)
    is_object = F.startswith(shape, F.lit("OBJECT"))
    inner = F.try_variant_get(v, f"$.{key}", "array<variant>")
    held = F.try_variant_get(v, f"$.{key}", "variant")
    absent = is_object & (held.isNull() | F.is_variant_null(held))
    items = F.when(F.startswith(shape, F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")).when(is_object, inner)
    whole = F.when(text == "", None).when(v.isNull(), "not_json").when(items.isNull() & ~F.coalesce(absent, F.lit(False)), "no_list")
    item = lambda x, why: F.struct(x.alias("item"), why.cast("string").alias("why"))
    none = F.array().cast("array<struct<item: variant, why: string>>")
    broken = F.array(item(v, whole))
    all_ = F.when(whole.isNotNull(), broken).when(items.isNotNull(), F.transform(items, lambda x: item(x, F.lit(None)))).otherwise(none)
    own = documents.select(*rest, F.col(content).alias("_content"), F.posexplode(all_).alias("pos", "_own"))
    x = F.col("_own.item")
    at = {n: F.try_variant_get(x, f"$.{n}", k) for n, k in kinds.items()}
    raw = {n: F.try_variant_get(x, f"$.{n}", "variant") for n in kinds}
    there = {n: raw[n].isNotNull() & ~F.coalesce(F.is_variant_null(raw[n]), F.lit(False)) for n in kinds}
    checks = [F.col("_own.why"), F.when(~F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), "not_an_object")]
    checks += [F.when(~there[n], f"missing_{n}") for n in required]
    checks += [F.when(there[n] & at[n].isNull(), f"bad_{n}") for n in kinds]
    own = own.withColumn("quarantine", F.coalesce(*checks))
    good = F.col("quarantine").isNull()
    return own.select(
        *rest, "pos", *(F.when(good, c).alias(n) for n, c in at.items()), "quarantine",
        F.when(~good, F.coalesce(F.to_json(x), F.col("_content"))).alias("raw"),
    )


def scalar(content: Column, field: str, kind: str, default) -> Column:
    """One value of a JSON object, or the default where it is absent, null or of another type."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(content), f"$.{field}", kind), F.lit(default).cast(kind))


def record_failures(failures: DataFrame, path: str, at: Column | None = None) -> None:
    """Append failures (url, keyword, reason) to the log, with a time; what is there already is not touched."""
    time = F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    failures.select("url", "keyword", "reason", time.alias("timestamp")).write.mode("append").json(path)


def failure_log(spark: SparkSession, path: str) -> DataFrame:
    """All records of a log, with ``quarantine``: a line that is no record of it, else null."""
    return spark.read.schema(f"{LOG}, quarantine string").option("columnNameOfCorruptRecord", "quarantine").json(path)
