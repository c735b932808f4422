"""The chunk index: versions of a table of vectors, of which readers see one whole, and embedding by a client that may fail."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from tesserae.operators.retrieval import index_changes

Client = Callable[[list[str]], list[list[float]]]


class Retryable(Exception):
    """What a client raises when the same call may succeed later."""


# Words in other errors that make a call worth repeating.
PASSING = ("[retryable]", "fetch failed", "network", "econnreset", "etimedout")


def called(client: Client, texts: list[str], attempts: int, pause: float, dims: int | None, sleep: Callable[[float], None]) -> tuple[list[list[float] | None], str | None]:
    """Vectors of the texts, or the reason why there are none.

    A failure that may pass is tried again after ``pause``, twice that, four times that; other failures, and answers
    with another number of vectors or dimensions, end the call at once.
    """
    none: list[list[float] | None] = [None] * len(texts)
    for k in range(attempts):
        try:
            out = [list(map(float, v)) for v in client(texts)]
            if len(out) != len(texts):
                return none, f"{len(out)} vectors for {len(texts)} texts"
            return (out, None) if dims is None or all(len(v) == dims for v in out) else (none, f"not {dims} dimensions")
        except Exception as error:
            said = f"{type(error).__name__}: {error}"
            if k == attempts - 1 or not (isinstance(error, Retryable) or any(x in said.lower() for x in PASSING)):
                return none, said
            sleep(pause * 2**k)
    return none, "no attempt"


def embedded_or_not(
    chunks: DataFrame, text: str, client: Client, batch: int = 10, attempts: int = 5, pause: float = 1.0, dims: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Adds ``vector`` and ``embed_error``; a batch that the client could not embed has no vectors and its reason.

    Batches of ``batch`` texts run on across Arrow batches within a task, in order. A failure is repeated within the
    task and is otherwise stated in its rows, so it costs neither the task nor what others have embedded. Rows with
    a null or empty text are not sent; their vector is null, without an error.
    """
    names = chunks.columns
    schema = StructType(list(chunks.schema.fields)).add("vector", ArrayType(DoubleType())).add("embed_error", StringType())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple] = []

        def out(rows: list[tuple]) -> pd.DataFrame:
            at = names.index(text)
            asked = [k for k, r in enumerate(rows) if r[at]]
            vectors, error = called(client, [rows[k][at] for k in asked], attempts, pause, dims, sleep) if asked else ([], None)
            found = dict(zip(asked, vectors, strict=True))
            return pd.DataFrame([(*r, found.get(k), error if k in found else None) for k, r in enumerate(rows)], columns=[*names, "vector", "embed_error"]).astype(object)

        for part in parts:
            waiting += part.astype(object).where(part.notna(), None).itertuples(index=False, name=None)
            while len(waiting) >= batch:
                yield out(waiting[:batch])
                del waiting[:batch]
        if waiting:
            yield out(waiting)

    return chunks.mapInPandas(run, schema)


class ChunkIndex:
    """A folder of versions of one table; the file ``current`` names the version that counts.

    A version is written whole and checked, and only then ``current`` is replaced, by a rename over it. A write that
    is killed leaves a folder that nothing names, and readers keep the version before. Versions stay until ``tidy``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        """The folder of the current version; None before the first."""
        if not self._files.exists(self._path("current")):
            return None
        return self.spark.read.text(f"{self.root}/current").first()[0]

    def read(self) -> DataFrame | None:
        """The table as it stands now; None before the first version."""
        own = self.version()
        return self.spark.read.parquet(f"{self.root}/{own}") if own else None

    def ids(self, id_col: str) -> DataFrame:
        """The ids of the index, null and empty ones left out: one column is read."""
        own = self.read()
        if own is None:
            return self.spark.createDataFrame([], f"{id_col} string")
        return own.select(id_col).where(F.coalesce(F.col(id_col).cast("string"), F.lit("")) != "")

    def replace(self, rows: DataFrame, rows_expected: int | None = None, check: Callable[[DataFrame], str | None] | None = None) -> int:
        """Make ``rows`` the table. No rows, another number than expected or what ``check`` says is an error; the old table stays."""
        own = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{own}")
        staged = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{own}")
        n = staged.count()  # from the files' footers
        wrong = "no rows" if not n else f"{n} rows in place of {rows_expected}" if rows_expected not in (None, n) else check(staged) if check else None
        if wrong:
            self._files.delete(self._path(own), True)
            raise ValueError(f"the index stays as it was: {wrong}")
        self._name(own)
        return n

    def _name(self, version: str) -> None:
        new = self._path(f"current-{version}")
        out = self._files.create(new)
        out.write((version + "\n").encode())
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else self._files.getUri())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._path("current"), options)

    def restore(self, version: str | None) -> None:
        """Name an earlier version again, or none."""
        if version:
            self._name(version)
        else:
            self._files.delete(self._path("current"), False)

    def tidy(self) -> list[str]:
        """Delete the versions that are not current, those of killed writes as well; returns their names."""
        now = self.version()
        old = [x.getPath().getName() for x in self._files.listStatus(self._path("")) if x.getPath().getName().startswith("v-")]
        old = [x for x in old if x != now]
        for name in old:
            self._files.delete(self._path(name), True)
        return old

    def refresh(self, chunks: DataFrame, id_col: str, text: str, client: Client, keep: tuple[str, ...] = (), **how) -> dict[str, int]:
        """Bring the index to the state of ``chunks``: new and changed texts are embedded, the other rows are kept.

        Columns of the index: ``id_col``, those of ``keep``, ``text_sha`` and ``vector``. Returns how many rows were
        missing, changed and stale; where there are none nothing is written. No chunks, null or repeated ids, and
        texts that could not be embedded are errors and leave the index as it was. ``how`` goes to ``embedded_or_not``.
        """
        now = chunks.select(id_col, *keep, text, F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha"))
        state = now.agg(F.count("*"), F.count(id_col), F.countDistinct(id_col)).first()
        if not state[0] or len(set(state)) > 1:
            raise ValueError(f"the index stays as it was: {state[0]} chunks, {state[1]} with an id, {state[2]} different ids")
        old = self.read()
        if old is None:
            todo, kept, counts = now, None, {"missing": state[0], "changed": 0, "stale": 0}
        else:
            changes = index_changes(old, now, id_col, "text_sha")
            counts = {k: 0 for k in ("missing", "changed", "stale")} | dict(changes.groupBy("change").count().collect())
            if not any(counts.values()):
                return counts
            todo = now.join(changes.where("change <> 'stale'").select(id_col), id_col, "left_semi")
            kept = now.drop(text).join(old.select(id_col, F.col("text_sha").alias("_sha"), "vector"), id_col).where("text_sha = _sha").drop("_sha")
        new = embedded_or_not(todo, text, client, **how).drop(text)
        rows = new.unionByName(kept.withColumn("embed_error", F.lit(None).cast("string"))) if kept is not None else new

        def failed(staged: DataFrame) -> str | None:
            first = staged.where("embed_error IS NOT NULL").select("embed_error").first()
            return f"not embedded ({first[0]})" if first else None

        self.replace(rows, state[0], failed)
        return counts
