"""Tables that change by whole versions: a reader sees one version from first row to last.

Rows lie in folders by a hash of their key. A version is a small file that names the folder of
each bucket; writing a version writes new folders for the buckets that change, names the old ones
for the others, and makes it the current one by renaming one file into the log. A reader looks up
the newest file once, so it never meets half of a write. Two writers that start from the same
version collide at the rename: one wins, the other is told and can try again on the new version.

Old versions stay readable until ``forget``. A commit can carry a name; a name that is in the log
already is not done again, so a batch that is replayed changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


class Collision(RuntimeError):
    """Another writer made a version first."""


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[str, str]
    name: str | None
    schema: str


class VersionedTable:
    """A table in a folder, by versions. ``keys`` name a row; ``buckets`` are what one upsert rewrites at least one of."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    # --- the log

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _log(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/_log")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """The version of a number, or the current one; None before the first."""
        log = self._log()
        if not log:
            return None
        wanted = log[-1] if number is None else number
        if wanted not in log:
            raise ValueError(f"no version {wanted}")
        fs, at = self._fs(f"{self.path}/_log/{wanted:020d}")
        stream = fs.open(at)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        found = json.loads(text)
        return Version(wanted, found["folders"], found["name"], found["schema"])

    def names(self) -> set[str]:
        return {v.name for n in self._log() if (v := self.version(n)).name}

    def _commit(self, before: Version | None, folders: dict[str, str], schema: str, name: str | None) -> Version:
        number = before.number + 1 if before else 1
        fs, draft = self._fs(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"folders": folders, "name": name, "schema": schema}).encode()))
        out.close()
        _, log = self._fs(f"{self.path}/_log")
        fs.mkdirs(log)
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{number:020d}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), none)  # refuses to replace a file
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Collision(f"version {number} of {self.path} is there already") from None
            raise
        return Version(number, folders, name, schema)

    # --- reading and writing

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version; they stay the same while newer ones are written."""
        v = self.version(number)
        if v is None:
            raise ValueError(f"nothing has been written to {self.path}")
        return self._rows(v, None)

    def _rows(self, v: Version, buckets: list[str] | None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, f in v.folders.items() if buckets is None or b in buckets]
        return self.spark.read.schema(v.schema).parquet(*folders) if folders else self.spark.createDataFrame([], v.schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows by buckets to a new folder; the folder of each bucket that has rows."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.mode("error").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, at = self._fs(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def replace(self, rows: DataFrame, name: str | None = None, check=None) -> Version:
        """A version of just these rows. ``check`` is given what has been written, and may refuse it by raising: the version is not made then."""
        before = self.version()
        folders, schema = self._write(rows), _ddl(rows)
        if check:
            check(self._rows(Version(0, folders, None, schema), None))
        return self._commit(before, folders, schema, name)

    def append(self, rows: DataFrame, name: str | None = None, check=None) -> Version:
        """A version with these rows beside those there are."""
        before = self.version()
        if before is None:
            return self.replace(rows, name, check)
        schema = before.schema
        fresh = self._write(_as(rows, schema, self.spark))
        if check:
            check(self._rows(Version(0, fresh, None, schema), None))
        return self._commit(before, {**before.folders, **{f"{b}+{uuid.uuid4().hex[:8]}": f for b, f in fresh.items()}}, schema, name)

    def upsert(self, rows: DataFrame, order: list[str] | None = None, name: str | None = None) -> Version:
        """A version in which rows with a known key replace the row there is, and others are added.

        Of several rows with one key the last by ``order`` counts, old ones included, so rows that
        come late or twice change nothing that is newer; without ``order`` new rows win, and each key
        must come once. Only buckets of these keys are written anew.
        """
        before = self.version()
        fresh = rows.withColumn("_new", F.lit(1))
        if before is None:
            buckets, old = None, None
        else:
            fresh = _as(rows, before.schema, self.spark).withColumn("_new", F.lit(1))
            buckets = [str(r[0]) for r in rows.select(self._bucket()).distinct().collect()]  # ``self.buckets`` at most
            touched = [b for b in before.folders if b.partition("+")[0] in buckets]
            old = self._rows(before, touched)
        every = fresh if old is None else old.withColumn("_new", F.lit(0)).unionByName(fresh)
        last = F.max_by(F.struct(*[c for c in every.columns if c != "_new"]), F.struct(*[F.col(c) for c in [*(order or []), "_new"]]))
        merged = every.groupBy(*[F.col(k).alias(f"_key_{k}") for k in self.keys]).agg(last.alias("_row"), F.sum("_new").alias("_times"))
        if order is None:
            merged = merged.where(F.when(F.col("_times") > 1, F.raise_error(F.lit("a key comes more than once; give an order"))).otherwise(F.lit(True)))
        folders = self._write(merged.select("_row.*"))
        kept = {} if before is None else {b: f for b, f in before.folders.items() if b.partition("+")[0] not in buckets}
        return self._commit(before, {**kept, **folders}, _ddl(rows) if before is None else before.schema, name)

    def forget(self, keep: int = 2) -> None:
        """Delete versions but the last ``keep``, and folders that none of these names."""
        log = self._log()
        gone, stay = log[:-keep], log[-keep:]
        used = {f for n in stay for f in self.version(n).folders.values()}
        unused = {f for n in gone for f in self.version(n).folders.values()} - used
        for path in [*(f"{self.path}/{f}" for f in unused), *(f"{self.path}/_log/{n:020d}" for n in gone)]:
            fs, at = self._fs(path)
            fs.delete(at, True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _as(rows: DataFrame, schema: str, spark: SparkSession) -> DataFrame:
    """Rows with the columns of a schema, in its order."""
    wanted = spark.createDataFrame([], schema).schema
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])
