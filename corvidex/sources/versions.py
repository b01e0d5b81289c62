"""Versions of several tables, published together: a manifest names every file folder of a version and is written last.

Tables lie in buckets by a hash of their key, and a bucket in layers. A change
writes its rows as new layers of the buckets of its keys, and beside them the keys
that older layers no longer count for; a reader leaves those out by one anti-join.
A bucket with many layers, or of which ``DEAD`` is gone, is written anew along with
the change. So a change costs what it touches, however much lies beside it, a
reader holds on to one whole version, and what a failed writer leaves is named by
no manifest. Manifests are numbered; a number is taken by renaming a finished file
without overwriting, so of two writers that began at one version the later is
refused (``Conflict``) and can begin again. Nothing is changed in place; old
folders stay until ``vacuum``.

Files are sorted by the key and carry Bloom filters on the columns named, so that
a lookup by key reads the buckets of its keys, and in them few row groups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_BUCKET = "__bucket"
_DEAL = "__deal"
DEALS = 1024  # parts into which rows are dealt before they are written: each in one bucket, and several to a task
LAYERS = 8  # of a bucket, at most, before a change writes the older ones as one
DEAD = 0.3  # of the keys of a bucket, by which it is written anew
SENT = 1_000_000  # keys that are sent to every task; more are joined by shuffle


class Conflict(RuntimeError):
    """Another writer has published a version in the meantime."""


@dataclass(frozen=True)
class Table:
    key: str
    buckets: int = 64
    blooms: tuple[str, ...] = ()

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def deal(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets * max(1, DEALS // self.buckets))).cast("int")


@dataclass(frozen=True)
class Version:
    number: int = 0
    tables: Mapping[str, dict] = field(default_factory=dict)  # name: {"schema": JSON, "buckets": {bucket: {"layers": [[folder, keys]], "gone": [[folder, keys]]}}}, the oldest first
    segments: Sequence[dict] = ()  # of the search index, the oldest first
    batches: Mapping[str, int] = field(default_factory=dict)  # stream: its last batch that is in this version
    fresh: Mapping[str, list[str]] = field(default_factory=dict, compare=False)  # name: folders of the new rows of its last change; not published


class Versions:
    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), dict(tables)
        self._jvm = spark._jvm
        at = self._path(self.root)
        self._files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def folder(self, kind: str, number: int = 0) -> str:
        """A new folder that no manifest names yet; of a table's folders those of later changes have greater numbers."""
        return f"{self.root}/data/{kind}/{number:012d}-{uuid.uuid4().hex}"

    def size(self, folders: Sequence[str]) -> int:
        """Bytes of the files in the folders (below the root)."""
        return sum(self._files.getContentSummary(self._path(f"{self.root}/{f}")).getLength() for f in folders)

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.root}/versions") if n.endswith(".json") and not n.startswith("."))

    def latest(self) -> Version:
        """The last version published; number 0 is the empty one."""
        numbers = self.numbers()
        return self.at(numbers[-1]) if numbers else Version()

    def at(self, number: int) -> Version:
        stream = self._files.open(self._path(f"{self.root}/versions/{number:012d}.json"))
        try:
            held = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, held["tables"], held["segments"], held["batches"])

    def publish(self, version: Version) -> Version:
        """Make ``version`` the one after its number; ``Conflict`` if that is taken."""
        number = version.number + 1
        name = f"{self.root}/versions/{number:012d}.json"
        draft = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps({"tables": version.tables, "segments": list(version.segments), "batches": version.batches}).encode()))
        out.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(draft, self._path(name), plain)
        except Py4JJavaError as e:
            self._files.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception.toString()):
                raise Conflict(f"version {number} of {self.root} is taken") from e
            raise
        return replace(version, number=number, fresh={})

    def read(self, name: str, version: Version | None = None, keys: Sequence | None = None) -> DataFrame:
        """A table of a version (the latest); with a few ``keys``, their rows from their buckets alone."""
        version = version or self.latest()
        if name not in version.tables:
            raise KeyError(f"no table {name} in version {version.number}")
        held, table = version.tables[name], self.tables[name]
        schema, buckets = T.StructType.fromJson(json.loads(held["schema"])), held["buckets"]
        if keys is not None:
            kind = schema[table.key].dataType
            wanted = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("k", kind)])).select(table.bucket(F.col("k"))).distinct().collect()
            buckets = {str(b): buckets[str(b)] for (b,) in wanted if str(b) in buckets}
        rows = self._live(table.key, schema, list(buckets.values()))
        return rows if keys is None else rows.where(F.col(table.key).isin(list(keys)))

    def _live(self, key: str, schema: T.StructType, buckets: Sequence[Mapping]) -> DataFrame:
        """Rows of the buckets whose key no later change has replaced."""
        if not buckets:
            return self.spark.createDataFrame([], schema)
        written = F.regexp_extract("_metadata.file_path", r"/(\d{12})-[0-9a-f]{32}/", 1).cast("long")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for b in buckets for f, _ in b["layers"]])
        gone = {f: n for b in buckets for f, n in b["gone"]}
        if not gone:
            return rows
        dead = self.spark.read.schema(T.StructType([schema[key]])).parquet(*[f"{self.root}/{f}" for f in gone]).select(F.col(key).alias("__gone"), written.alias("__last"))
        dead = F.broadcast(dead) if sum(gone.values()) <= SENT else dead
        rows = rows.withColumn("__at", written)
        return rows.join(dead, (F.col(key) == F.col("__gone")) & (F.col("__at") < F.col("__last")), "left_anti").select(schema.names)

    def dealt(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` dealt so that ``change`` needs no further shuffle, nor do windows partitioned by ``by_key``."""
        return rows.withColumn(_DEAL, self.tables[name].deal(F.col(self.tables[name].key))).repartition(_DEAL)

    def by_key(self, name: str) -> list[str]:
        """What windows over the keys of ``dealt`` rows are partitioned by."""
        return [_DEAL, self.tables[name].key]

    def _write(self, name: str, rows: DataFrame, number: int) -> dict[str, list]:
        """Write the rows; gives the folder and the number of keys of each bucket that has some."""
        table = self.tables[name]
        to = self.folder(name, number)
        placed = rows.withColumn(_BUCKET, table.bucket(F.col(table.key)))
        # Rebalanced, so that a key with very many rows is written by several tasks.
        placed = (placed.drop(_DEAL) if _DEAL in rows.columns else placed.hint("rebalance", _BUCKET)).sortWithinPartitions(_BUCKET, table.key)
        # A Bloom filter is as large as its file's values need, else a small file would hold a MB of it.
        writer = placed.write.partitionBy(_BUCKET).option("compression", "zstd").option("parquet.bloom.filter.adaptive.enabled", "true")
        for column in table.blooms:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(to)
        if not any(n.startswith(_BUCKET) for n in self._names(to)):
            return {}
        stored = self.spark.read.schema(T.StructType([rows.schema[table.key], T.StructField(_BUCKET, T.IntegerType())])).parquet(to)
        counts = stored.distinct().groupBy(_BUCKET).agg(F.count("*")).collect()
        return {str(b): [f"{to.removeprefix(self.root + '/')}/{_BUCKET}={b}", n] for b, n in counts}

    def change(self, version: Version, name: str, new: DataFrame, gone: DataFrame | None = None) -> Version:
        """``version`` with the rows of the keys in ``new`` and ``gone`` replaced by ``new``: written, not published.

        Of all buckets, those of these keys are looked at. ``new`` may be ``dealt``.
        """
        table, before = self.tables[name], version.tables.get(name)
        buckets = dict(before["buckets"]) if before else {}
        number = 1 + max([0, *(int(f.split("/")[-2][:12]) for b in buckets.values() for f, _ in [*b["layers"], *b["gone"]])])
        schema = T.StructType.fromJson(json.loads(before["schema"])) if before else T.StructType([T.StructField(f.name, f.dataType) for f in new.schema if f.name != _DEAL])
        new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], *[c for c in new.columns if c == _DEAL])
        fresh = self._write(name, new, number)
        if buckets:
            one = T.StructType([schema[table.key]])
            keys = self.spark.read.schema(one).parquet(*[f"{self.root}/{f}" for f, _ in fresh.values()]) if fresh else self.spark.createDataFrame([], one)
            if gone is not None:
                keys = keys.union(gone.select(F.col(table.key).cast(schema[table.key].dataType)))
            keys = keys.distinct()
            at = {str(b) for (b,) in keys.select(table.bucket(F.col(table.key))).distinct().collect()} & buckets.keys()
            dead = self._dead(name, keys, [buckets[b] for b in at], one, number)
            old = {b: {"layers": buckets[b]["layers"], "gone": buckets[b]["gone"] + dead.get(b, [])} for b in at}
            anew = [b for b, x in old.items() if len(x["layers"]) >= LAYERS or sum(n for _, n in x["gone"]) > DEAD * sum(n for _, n in x["layers"])]
            if anew:
                merged = self._write(name, self._live(table.key, schema, [old[b] for b in anew]), number)
                old |= {b: {"layers": [merged[b]] if b in merged else [], "gone": []} for b in anew}
            buckets |= old
        for b, layer in fresh.items():
            held = buckets.get(b, {"layers": [], "gone": []})
            buckets[b] = {"layers": [*held["layers"], layer], "gone": held["gone"]}
        buckets = {b: x for b, x in buckets.items() if x["layers"]}
        return replace(version, tables={**version.tables, name: {"schema": schema.json(), "buckets": buckets}}, fresh={**version.fresh, name: [f for f, _ in fresh.values()]})

    def fresh(self, name: str, version: Version) -> DataFrame:
        """The new rows of the last change of a table, as they are written."""
        schema, folders = T.StructType.fromJson(json.loads(version.tables[name]["schema"])), version.fresh.get(name)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _dead(self, name: str, keys: DataFrame, buckets: Sequence[Mapping], one: T.StructType, number: int) -> dict[str, list[list]]:
        """Write which of the keys the buckets hold; gives a list of one folder and their number for each bucket that has some."""
        if not buckets:
            return {}
        table = self.tables[name]
        held = self._live(table.key, one, buckets).distinct()
        to = self.folder(f"{name}-gone", number)
        found = keys.join(held, table.key, "left_semi").withColumn(_BUCKET, table.bucket(F.col(table.key)))
        found.hint("rebalance", _BUCKET).sortWithinPartitions(_BUCKET, table.key).write.partitionBy(_BUCKET).parquet(to)
        if not any(n.startswith(_BUCKET) for n in self._names(to)):
            return {}
        counts = self.spark.read.schema(T.StructType([*one, T.StructField(_BUCKET, T.IntegerType())])).parquet(to).groupBy(_BUCKET).agg(F.count("*")).collect()
        return {str(b): [[f"{to.removeprefix(self.root + '/')}/{_BUCKET}={b}", n]] for b, n in counts}

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that none of the last ``keep`` versions names, and older manifests; gives the number of folders.

        Only when no writer is at work, and no reader holds an older version.
        """
        numbers = self.numbers()
        held = set()
        for n in numbers[-keep:]:
            version = self.at(n)
            held |= {f for t in version.tables.values() for b in t["buckets"].values() for f, _ in [*b["layers"], *b["gone"]]} | {s["folder"] for s in version.segments}
        gone = 0
        for kind in self._names(f"{self.root}/data"):
            for name in self._names(f"{self.root}/data/{kind}"):
                base = f"data/{kind}/{name}"
                parts = [f"{base}/{p}" for p in self._names(f"{self.root}/{base}") if p.startswith(_BUCKET)]
                if base in held or any(p in held for p in parts):
                    parts = [p for p in parts if p not in held] if base not in held else []
                else:
                    parts = [base]
                for p in parts:
                    self._files.delete(self._path(f"{self.root}/{p}"), True)
                gone += len(parts)
        for n in numbers[:-keep]:
            self._files.delete(self._path(f"{self.root}/versions/{n:012d}.json"), False)
        return gone
