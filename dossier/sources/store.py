"""Generations of the stores: a base and a log of changes a store, and one pointer that names what is live.

A write puts rows into folders of generation n + 1, verifies them, and only then moves the pointer, which lists for each
store the parts that hold its rows: a whole table, and the changes made since, rows with their new revision or a tombstone.
So a write of k rows writes k rows, whatever the store's size, and readers that resolved the pointer see one snapshot.
Reads merge the parts by key, the newest one wins; `compact` makes one whole table of them.

Rows lie in ranges of their key. The lowest and highest key of each file of a whole table, and of each set of changes, are
kept, so that `get` opens only files that can hold a key.

One writer at a time: Parquet has no transactions, and two writers would both make the same generation. Paths are Hadoop
paths; nothing is written to a local folder of the driver.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.lifecycle import prepare_files, store_counts, written
from dossier.operators.relations import without_bytes
from dossier.schemas import KEYS, STORES, VERSION

#: Writes of up to so many rows look up the rows they replace by key; larger ones read the store's keys.
FEW = 1000
POINTER = "generation int, version int, stores map<string, array<struct<generation: int, whole: boolean, low: string, high: string, n: bigint>>>"


class RevConflict(ValueError):
    """Writes that expected another revision; `rows` has (key, expectedRev, currentRev) of the first ones."""

    def __init__(self, name: str, rows: list):
        super().__init__(f"{name}: {len(rows)} writes or more expected another revision: {rows[:3]}")
        self.rows = rows


class Part(NamedTuple):
    """What a generation wrote of a store: the whole table, or changes. Keys are kept as text."""

    generation: int
    whole: bool
    low: str | None
    high: str | None
    n: int


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- the pointer

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def generation(self) -> int:
        """The live generation; 0 before the first write. Data of a newer schema version is refused."""
        fs, at = self._fs(f"{self.path}/pointers")
        if not fs.exists(at):
            return 0
        row = self.spark.read.schema(POINTER).json(f"{self.path}/pointers/*").select("generation", "version").orderBy(F.col("generation").desc()).first()
        if row is None:
            return 0
        if row.version > VERSION:
            raise ValueError(f"the store has schema version {row.version}; this code knows {VERSION}")
        return row.generation

    def parts(self, generation: int | None = None) -> dict[str, list[Part]]:
        """For each store the parts that hold its rows as of a generation, oldest first."""
        n = self.generation() if generation is None else generation
        row = self.spark.read.schema(POINTER).json(f"{self.path}/pointers/{n:08d}").first() if n > 0 else None
        return {name: [Part(*p) for p in parts] for name, parts in row.stores.items()} if row else {}

    def _point(self, n: int, parts: dict[str, list[Part]]) -> int:
        rows = self.spark.createDataFrame([(n, VERSION, {k: [tuple(p) for p in v] for k, v in parts.items()})], POINTER)
        rows.coalesce(1).write.mode("overwrite").json(f"{self.path}/pointers/{n:08d}")
        return n

    # --- reads

    def _folder(self, name: str, part: Part) -> str:
        return f"{self.path}/gen={part.generation}/{name}" + ("" if part.whole else ".changes")

    def _rows(self, name: str, part: Part, *files: str) -> DataFrame:
        """The rows of a part, or of some of its files; _gone tells tombstones."""
        folder = self._folder(name, part)
        return self.spark.read.schema(f"{STORES[name]}, _gone boolean").parquet(*([f"{folder}/{f}" for f in files] or [folder]))

    def _merged(self, name: str, frames: list[tuple[Part, DataFrame]]) -> DataFrame:
        """Rows of a store from those of its parts, oldest first: of each key the newest one, unless that is a tombstone."""
        key, columns = KEYS[name], self._schema(name).names
        whole = [df for part, df in frames if part.whole]
        changes = [df.withColumn("_at", F.lit(part.generation)) for part, df in frames if not part.whole]
        base = whole[0].select(columns) if whole else self.spark.createDataFrame([], STORES[name])
        if not changes:
            return base
        newest = reduce(DataFrame.union, changes)
        if len(changes) > 1:
            newest = newest.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*newest.columns), "_at").alias("r")).select("r.*")
        rest = base.join(newest.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")
        return rest.union(newest.where("not coalesce(_gone, false)").select(columns))

    def _schema(self, name: str):
        return self.spark.createDataFrame([], STORES[name]).schema

    def _at(self, name: str, parts: dict[str, list[Part]]) -> DataFrame:
        return self._merged(name, [(p, self._rows(name, p)) for p in parts.get(name, [])])

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        return self._at(name, self.parts(generation))

    def snapshot(self) -> dict[str, DataFrame]:
        parts = self.parts()
        return {name: self._at(name, parts) for name in STORES}

    def get(self, name: str, keys: list | DataFrame, generation: int | None = None) -> DataFrame:
        """The rows of some keys: a list of them, or a table with the store's key. Only files whose range of keys holds one
        are opened; more than FEW keys are joined with the store's instead."""
        key = KEYS[name]
        if isinstance(keys, DataFrame):
            few = [r[0] for r in keys.select(key).where(F.col(key).isNotNull()).distinct().limit(FEW + 1).collect()]
            if len(few) > FEW:
                return self.read(name, generation).join(keys.select(key).distinct(), key, "left_semi")
            keys = few
        kind = self._schema(name)[key].dataType
        keys = sorted(k for k in keys if k is not None)
        if len(keys) > FEW:
            return self.get(name, self.spark.createDataFrame([(k,) for k in keys], f"{key} {kind.simpleString()}"), generation)
        wanted = F.col(key).isin(keys)
        frames = []
        for part in self.parts(generation).get(name, []):
            if part.whole:
                files = [r.file for r in self._files(name, part).collect() if _holds(r.low, r.high, keys)]
                frames += [(part, self._rows(name, part, *files).where(wanted))] if files else []
            elif _holds(_of(kind, part.low), _of(kind, part.high), keys):
                frames.append((part, self._rows(name, part).where(wanted)))
        return self._merged(name, frames)

    def _files(self, name: str, part: Part) -> DataFrame:
        key = self._schema(name)[KEYS[name]].dataType.simpleString()
        return self.spark.read.schema(f"file string, low {key}, high {key}, n bigint").parquet(f"{self.path}/gen={part.generation}/{name}.files")

    # --- writes

    def _shaped(self, name: str, rows: DataFrame, *more: str) -> DataFrame:
        """Rows with the columns of a store; those that are not given are null, others go."""
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self._schema(name)], *more)

    def _write(self, name: str, n: int, rows: DataFrame, whole: bool) -> Part | None:
        """Writes rows in ranges of their key, and what is known of their files. Changes without rows are no part."""
        key = KEYS[name]
        rows = rows if "_gone" in rows.columns else rows.withColumn("_gone", F.lit(False))
        shaped = self._shaped(name, rows, "_gone")
        part = Part(n, whole, None, None, 0)
        shaped.repartitionByRange(F.col(key).asc()).sortWithinPartitions(key).write.mode("overwrite").parquet(self._folder(name, part))
        files = self._rows(name, part).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))
        if whole:
            files.write.mode("overwrite").parquet(f"{self.path}/gen={n}/{name}.files")
            files = self._files(name, part)
        told = files.agg(F.min("low").cast("string").alias("low"), F.max("high").cast("string").alias("high"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        return Part(n, whole, told.low, told.high, told.n) if whole or told.n else None

    def _make(self, wholes: dict[str, DataFrame], changes: dict[str, DataFrame], verify: bool, expected: dict[str, int] | None = None) -> int:
        live = self.generation()
        n, parts = live + 1, self.parts(live)
        self._delete(f"{self.path}/gen={n}")  # left over from a writer that died
        for name, rows in wholes.items():
            parts[name] = [self._write(name, n, rows, True)]
        for name, rows in changes.items():
            part = self._write(name, n, rows, False)
            parts[name] = [*parts.get(name, []), *([part] if part else [])]
        problems = self.problems(parts, n) if verify else []
        problems += [f"{name} has {got} rows instead of {expected[name]}" for name in expected or {} if (got := self._at(name, parts).count()) != expected[name]]
        if problems:
            self._delete(f"{self.path}/gen={n}")
            raise ValueError(f"generation {n} not made live: {problems}")
        return self._point(n, parts)

    def commit(self, changes: dict[str, DataFrame], verify: bool = True) -> int:
        """Replaces whole stores; the others stay where they are. A failed check leaves the live generation untouched."""
        return self._make(changes, {}, verify)

    def apply(self, puts: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None, verify: bool = True) -> int:
        """Rows that are put as they are, and keys that go, as one generation. Only these rows are written and checked."""
        changes = dict(puts or {})
        for name, keys in (gone or {}).items():
            stones = keys.select(KEYS[name]).distinct().withColumn("_gone", F.lit(True))
            changes[name] = changes[name].withColumn("_gone", F.lit(False)).unionByName(stones, allowMissingColumns=True) if name in changes else stones
        return self._make({}, changes, verify)

    def _replaced(self, name: str, rows: DataFrame) -> DataFrame:
        """The stored rows that have the keys of `rows`."""
        return self.get(name, rows)

    def put(self, name: str, rows: DataFrame, verify: bool = True) -> int:
        """Writes rows with the revision after the stored one's. A column expectedRev guards against lost updates: if a
        stored row has another revision (0: none is stored), nothing is written."""
        rows = rows if "expectedRev" in rows.columns else rows.withColumn("expectedRev", F.lit(None).cast("long"))
        good, bad = written(self._replaced(name, rows), rows, KEYS[name])
        conflicts = bad.limit(100).collect()
        if conflicts:
            raise RevConflict(name, conflicts)
        return self.apply({name: good}, verify=verify)

    def remove(self, name: str, keys: DataFrame, verify: bool = True) -> int:
        return self.apply(gone={name: keys.join(self._replaced(name, keys).select(KEYS[name]), KEYS[name], "left_semi")}, verify=verify)

    def put_full(self, files: DataFrame, as_of: int) -> int:
        """Files (columns of the store, blob and thumb) as rows of files, blobs and thumbs; bytes are hashed, and checked again
        once they are written. A null thumb leaves a stored one as it is."""
        rows = files.withColumn("size", F.octet_length("blob").cast("long"))
        meta = prepare_files(self._shaped("files", rows), as_of)
        good, _ = written(self._replaced("files", meta), meta.withColumn("expectedRev", F.lit(None).cast("long")), "id")
        blobs = rows.select("id", "blob", "size", F.sha2("blob", 256).alias("sha256"))
        thumbs = rows.where("thumb is not null").select("id", F.col("thumb").alias("blob"))
        return self.apply({"files": good, "blobs": blobs, "thumbs": thumbs})

    def restore(self, stores: dict[str, DataFrame], expected: dict[str, int] | None = None, as_of: int = 0) -> int:
        """Makes the stores of a backup live, all of them, once they are verified (expected: rows of each), and then deletes
        what older generations hold. If anything is wrong the live generation stays."""
        note = self.spark.createDataFrame([("backup.restored", str(as_of), 1)], "key string, value string, rev long")
        settings = stores.get("settings")
        note = note if settings is None else settings.where("key <> 'backup.restored'").unionByName(note, allowMissingColumns=True)
        whole = {name: stores.get(name, self.spark.createDataFrame([], STORES[name])) for name in STORES}
        n = self._make(whole | {"settings": note}, {}, True, {k: v for k, v in (expected or {}).items() if k != "settings"})
        for old in range(1, n):
            self.drop(old)
        return n

    def compact(self, *names: str) -> int:
        """One whole table each of the named stores, or of all that have changes."""
        parts = self.parts()
        chosen = [k for k, v in parts.items() if (k in names if names else len(v) > 1)]
        return self._make({k: self._at(k, parts) for k in chosen}, {}, False, {k: self._at(k, parts).count() for k in chosen}) if chosen else self.generation()

    # --- checks and upkeep

    def problems(self, parts: dict[str, list[Part]], n: int) -> list[str]:
        """What generation n would lack: bytes of files, right hashes, single keys. Only what it wrote is looked at, so
        bytes that were verified before are not read again; if bytes go, all files are asked for theirs, by key."""
        new = {name: held[-1] for name, held in parts.items() if held and held[-1].generation == n}
        rows = {name: self._rows(name, p) for name, p in new.items()}
        named = {f"{name} with one key": df.groupBy(KEYS[name]).count().where("count > 1").count() for name, df in rows.items() if name not in ("log",)}
        blobs = self._at("blobs", parts)
        if "blobs" in new:
            named["blobs with a wrong hash"] = rows["blobs"].where("not _gone and sha256 is not null and sha256 <> '' and sha2(blob, 256) <> sha256").count()
        if "blobs" in new and (new["blobs"].whole or not rows["blobs"].where("_gone").isEmpty()):
            named["files without bytes"] = without_bytes(self._at("files", parts), blobs).count()
        elif "files" in new:
            named["files without bytes"] = without_bytes(rows["files"].where("not _gone"), blobs).count()
        return [f"{k}: {v}" for k, v in named.items() if v]

    def counts(self) -> DataFrame:
        return store_counts(self.snapshot())

    def drop(self, n: int) -> None:
        """Deletes what generation n wrote, but for the parts that the live one still reads."""
        live = self.generation()
        if n == live:
            raise ValueError("the live generation stays")
        needed = {(name, p.whole) for name, held in self.parts(live).items() for p in held if p.generation == n}
        for name in STORES:
            if (name, True) not in needed:
                self._delete(f"{self.path}/gen={n}/{name}")
                self._delete(f"{self.path}/gen={n}/{name}.files")
            if (name, False) not in needed:
                self._delete(f"{self.path}/gen={n}/{name}.changes")
        self._delete(f"{self.path}/pointers/{n:08d}")


def _holds(low, high, keys: list) -> bool:
    """Whether one of the sorted keys lies between two bounds; a null bound has none beyond it."""
    if low is None or high is None:
        return False
    at = bisect_left(keys, low)
    return at < len(keys) and keys[at] <= high


def _of(kind, text: str):
    return text if kind.simpleString() == "string" else int(text)
