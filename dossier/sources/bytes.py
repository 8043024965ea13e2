"""Container files of any size as a Spark data source: byte ranges of payloads are its partitions.

    spark.dataSource.register(Containers)
    rows = spark.read.format("containers").option("path", "s3://bucket/backups").load()
    write(rows, "file:///backups/new.fdb", "fdb")

The header of a file is read once, while the scan is planned, and the whole file is checked against it before any row comes
out; a bad file gives a single row with its error code. Payloads are then read by many tasks, each of some RANGE bytes, in
batches of BATCH bytes. Only a single payload has to fit into one binary value (2 GB).

To write, each task puts its payloads into a file of its own beside the target; the commit lays a header and these files one
after the other. A container is one file, so its bytes are copied by one writer, a block at a time, and appear at once.
Files are reached through pyarrow's file systems (local, s3, gs, hdfs).
"""

from __future__ import annotations

import codecs
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from dossier.sources.containers import MAGIC, ROWS, header_of

RANGE, BATCH, BLOCK = 64 << 20, 8 << 20, 4 << 20
ROWS_OF_RANGE = 100_000
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("error", pa.string()), ("part", pa.string()), ("pos", pa.int32()), ("id", pa.string()), ("meta", pa.string()), ("content", pa.binary())])
_KINDS = {magic: kind for kind, (magic, _) in MAGIC.items()}


def _found(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file system of a path, and the file there or all files below."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    listed = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
    return system, sorted((i for i in listed if i.is_file), key=lambda i: i.path)


@dataclass
class Range(InputPartition):
    """What one task reads: items `rows` of a list of the header, the first of which stands at byte `head` of the file, and
    their payloads, whose bytes begin at `at`; or an error. Rows themselves stay in the file."""

    path: str
    kind: str | None
    error: str | None
    at: int
    rows: range
    named: str = ""
    head: int = 0
    end: int = 0


class _Json:
    """JSON of a file, a block at a time: only one value is held at once."""

    def __init__(self, f, at: int, end: int):
        self.f, self.left, self.at, self.text, self.k, self.mark = f, end - at, at, "", 0, 0
        self.decoder, self.utf8 = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8")()

    def _more(self) -> bool:
        """Reads on; what is done with is dropped, and `at` is the byte at which the rest begins."""
        done, self.text = self.text[: self.k], self.text[self.k :]
        self.k, self.mark = 0, max(self.mark - self.k, 0)
        self.at += len(done.encode())
        data = self.f.read(min(self.left, max(BLOCK, len(self.text)))) if self.left else b""
        self.left = self.left - len(data) if data else 0
        self.text += self.utf8.decode(data, not self.left)
        return bool(data)

    def next(self) -> str:
        """The next character that is no space, which stays; empty at the end."""
        while True:
            while self.k < len(self.text):
                if self.text[self.k] not in " \t\n\r":
                    return self.text[self.k]
                self.k += 1
            if not self._more():
                return ""

    def took(self, c: str) -> bool:
        found = self.next() == c
        self.k += found
        return found

    def need(self, c: str) -> None:
        if not self.took(c):
            raise ValueError("BAD_METADATA")

    def begun(self) -> int:
        """The byte of the file at which the last value began."""
        return self.at + len(self.text[: self.mark].encode())

    def value(self):
        self.next()
        self.mark = self.k
        while True:
            try:
                found, end = self.decoder.raw_decode(self.text, self.k)
            except json.JSONDecodeError:
                if not self.left:
                    raise ValueError("BAD_METADATA") from None
                self._more()
                continue
            if end == len(self.text) and self.left:  # a number may go on
                self._more()
                continue
            self.k = end
            return found

    def keys(self) -> Iterator[str]:
        """The keys of an object, whose values the caller takes."""
        self.need("{")
        if self.took("}"):
            return
        while True:
            key = self.value()
            if not isinstance(key, str):
                raise ValueError("BAD_METADATA")
            self.need(":")
            yield key
            if not self.took(","):
                break
        self.need("}")

    def items(self) -> Iterator:
        self.need("[")
        if self.took("]"):
            return
        while True:
            yield self.value()
            if not self.took(","):
                break
        self.need("]")


_LISTS = {"fdb": ("payloads",), "tidb": ("tools", "photos"), "fvault": ("files",)}
_NEEDED = {"fdb": {"records", "payloads"}, "tidb": {"tools"}, "fvault": {"files"}}


def _rows(named: str, k: int, item: dict) -> list[tuple]:
    """(part, pos, id, record, bytes; null: none, code if they are missing) of an item of a list, as containers.layout_of has them."""
    if named.startswith("record:"):
        return [(named, k, item.get("id", item.get("vin", item.get("key"))), item, None, None)]
    if named == "tools":
        return [("tool", k, item.get("id"), item, None, None)]
    if named in ("payloads", "photos"):
        part = "photo" if named == "photos" else "payload:" + item["store"]
        return [(part, k, item["id"], item, item["len"], "TRUNCATED_PAYLOAD")]
    if item.get("size") is not None and item["size"] != item["blobLen"]:
        raise ValueError("SIZE_MISMATCH")
    return [("blob", 2 * k, item["id"], item, item["blobLen"], "TRUNCATED_BLOB"), ("thumb", 2 * k + 1, item["id"], None, item.get("thumbLen") or 0, "TRUNCATED_THUMB")]


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str | None, size: int):
        self.path, self.kind, self.size = path, kind, size

    def partitions(self) -> list[Range]:
        system, files = _found(self.path)
        return [r for info in files for r in self._ranges(system, info)] or [Range(self.path, None, None, 0, range(0))]

    def _ranges(self, system: fs.FileSystem, info: fs.FileInfo) -> Iterator[Range]:
        with system.open_input_file(info.path) as f:
            head = f.read(12)
            kind = self.kind or _KINDS.get(head[:4])
            try:
                if kind not in MAGIC:
                    raise ValueError("UNKNOWN_FORMAT")
                _, at = header_of(head, lambda n: b'{"format": "looked at below"}', info.size, kind)
                found = self._planned(_Json(f, 12, at), info, kind, at)
            except ValueError as e:
                yield Range(info.path, kind, "BAD_METADATA" if isinstance(e, UnicodeDecodeError) else str(e), 0, range(0))
                return
        yield from found or [Range(info.path, kind, None, at, range(0))]

    def _planned(self, header: _Json, info: fs.FileInfo, kind: str, start: int) -> list[Range]:
        """The ranges of a file. Its header is gone through item by item and not kept."""
        found: list[Range] = []
        at, wrong, lacks, form, seen = start, "", "", None, set()

        def listed(named: str) -> None:
            nonlocal at, wrong, lacks
            n, first = 0, None
            for k, item in enumerate(header.items()):
                try:
                    rows = _rows(named, k, item)
                except (KeyError, TypeError, AttributeError):
                    raise ValueError("BAD_METADATA") from None
                except ValueError as e:
                    wrong, rows = wrong or str(e), []
                size = 0
                for *_, bytes_, code in rows:
                    if code and (not isinstance(bytes_, int) or bytes_ < 0 or at + size + bytes_ > info.size):
                        lacks = lacks or code
                    elif code:
                        size += bytes_
                if first is None or n + size > self.size or k - first.rows.start >= ROWS_OF_RANGE:
                    first, n = Range(info.path, kind, None, at, range(k, k), named, header.begun(), start), 0
                    found.append(first)
                first.rows = range(first.rows.start, k + 1)
                n, at = n + size, at + size

        for key in header.keys():
            if key in seen:
                raise ValueError("BAD_METADATA")
            seen.add(key)
            if kind == "fdb" and key == "records":
                stores: set = set()
                for store in header.keys():
                    if store in stores:
                        raise ValueError("BAD_METADATA")
                    stores.add(store)
                    listed("record:" + store)
            elif key in _LISTS[kind]:
                listed(key)
            else:
                value = header.value()
                form = value if key == "format" else form
        if header.next() or not isinstance(form, str) or not form or not _NEEDED[kind] <= seen:
            raise ValueError("BAD_METADATA")
        if wrong or lacks or at != info.size:
            raise ValueError(wrong or lacks or "TRAILING_BYTES")
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.error:
            yield pa.RecordBatch.from_pylist([{"path": partition.path, "kind": partition.kind, "error": partition.error}], schema=_ARROW)
            return
        if not partition.rows:
            return
        system, files = _found(partition.path if "://" in partition.path or "://" not in self.path else f"{self.path.split('://')[0]}://{partition.path}")
        with system.open_input_file(files[0].path) as f, system.open_input_file(files[0].path) as told:
            f.seek(partition.at)
            told.seek(partition.head)
            header = _Json(told, partition.head, partition.end)
            held: list[dict] = []
            n = 0
            for part, pos, id_, record, size in self._told(header, partition):
                content = None if size is None else f.read(size)
                meta = None if record is None else json.dumps(record)
                if part == "thumb" and not size:
                    continue
                held.append({"path": partition.path, "kind": partition.kind, "part": part, "pos": pos, "id": id_, "meta": meta, "content": content})
                n += (size or 0) + len(meta or "")
                if n >= BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    def _told(self, header: _Json, partition: Range) -> Iterator[tuple]:
        for k in partition.rows:
            if k > partition.rows.start:
                header.need(",")
            yield from (row[:5] for row in _rows(partition.named, k, header.value()))


@dataclass
class _Written(WriterCommitMessage):
    """The payload file of a task (null: none), the file of its rows (part, id, meta, size), a line of JSON each, and their
    first pos. Rows do not pass the driver's memory."""

    file: str | None
    rows: str | None
    first: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str, meta: dict, overwrite: bool):
        self.path, self.kind, self.meta, self.overwrite = path, kind, meta, overwrite
        self.parts = f"{path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator) -> _Written:
        system, at = fs.FileSystem.from_uri(self.parts) if "://" in self.parts else (fs.LocalFileSystem(), self.parts)
        system.create_dir(at, recursive=True)
        file, out, first, lines = f"{at}/{uuid.uuid4().hex}", None, None, None
        try:
            for r in iterator:
                if r.content is not None:
                    out = out or system.open_output_stream(file)
                    out.write(bytes(r.content))
                first = r.pos if first is None else first
                lines = lines or system.open_output_stream(f"{file}.rows")
                lines.write(json.dumps((r.part, r.id, r.meta, None if r.content is None else len(r.content))).encode() + b"\n")
        finally:
            for stream in (out, lines):
                if stream:
                    stream.close()
        return _Written(file if out else None, f"{file}.rows" if lines else None, first or 0)

    def _target(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def commit(self, messages: list[_Written | None]) -> None:
        system, at = self._target()
        if not self.overwrite and system.get_file_info(at).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        order = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)

        def told() -> Iterator[tuple]:
            for m in order:
                with system.open_input_stream(m.rows) as f:
                    for part, id_, meta, size in map(json.loads, io.TextIOWrapper(f, "utf-8")):
                        yield part, id_, json.loads(meta) if meta else {}, size

        magic, version = MAGIC[self.kind]
        whole, head = f"{at}.{uuid.uuid4().hex}.new", f"{at}.{uuid.uuid4().hex}.head.new"
        try:
            n = 0
            with system.open_output_stream(head) as out:
                for piece in head_pieces(self.kind, self.meta, told):
                    data = piece.encode()
                    out.write(data)
                    n += len(data)
            with system.open_output_stream(whole) as out:
                out.write(magic + version.to_bytes(4, "little") + n.to_bytes(4, "little"))
                with system.open_input_stream(head) as f:
                    while block := f.read(BLOCK):
                        out.write(block)
                for m in order:
                    if m.file:
                        with system.open_input_stream(m.file) as f:
                            while block := f.read(BLOCK):
                                out.write(block)
        finally:
            if system.get_file_info(head).type != fs.FileType.NotFound:
                system.delete_file(head)
        system.move(whole, at)  # it is there as a whole or not at all
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        system, at = fs.FileSystem.from_uri(self.parts) if "://" in self.parts else (fs.LocalFileSystem(), self.parts)
        if system.get_file_info(at).type != fs.FileType.NotFound:
            system.delete_dir(at)


def head_pieces(kind: str, meta: dict, told) -> Iterator[str]:
    """The header of a container in pieces, from told(), its rows (part, id, record, size) in order: what the records say, and
    the sizes of the payloads. meta may give the format's own name."""
    text = lambda x: json.dumps(x, ensure_ascii=False)
    names = {"fdb": "backup", "tidb": "catalogue", "fvault": "vault"}
    own = {"records", *_LISTS[kind]} if kind == "fdb" else set(_LISTS[kind])

    def joined(items) -> Iterator[str]:
        yield "["
        for k, item in enumerate(items):
            yield (", " if k else "") + text(item)
        yield "]"

    yield text({"format": names[kind], **{k: v for k, v in meta.items() if k not in own}})[:-1]
    if kind == "fdb":
        yield ', "records": {'
        for k, store in enumerate(dict.fromkeys(part for part, *_ in told() if part.startswith("record:"))):
            yield (", " if k else "") + text(store[7:]) + ": "
            yield from joined(m for part, _, m, _ in told() if part == store)
        yield '}, "payloads": '
        yield from joined({**m, "store": part[8:], "id": id_, "len": size} for part, id_, m, size in told() if part.startswith("payload:"))
    elif kind == "tidb":
        yield ', "tools": '
        yield from joined(m for part, _, m, _ in told() if part == "tool")
        yield ', "photos": '
        yield from joined({**m, "id": id_, "len": size} for part, id_, m, size in told() if part == "photo")
    else:
        yield ', "files": '
        yield from joined(_with_thumbs(told()))
    yield "}"


def _with_thumbs(told) -> Iterator[dict]:
    """Files of a vault; a preview is told right after its file."""
    file = None
    for part, id_, m, size in told:
        if part == "blob":
            if file:
                yield file
            file = {**m, "id": id_, "size": size, "blobLen": size, "thumbLen": 0}
        elif file and file["id"] == id_:
            file["thumbLen"] = size
        else:
            raise ValueError(f"the preview of {id_} does not follow its file")
    if file:
        yield file


class Containers(DataSource):
    """Options: path (a file or a folder), kind (by content if not given), range (bytes of payload a task), meta (JSON that the
    header of a written file has besides)."""

    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("kind"), int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["kind"], json.loads(self.options.get("meta", "{}")), overwrite)


def write(rows: DataFrame, path: str, kind: str, meta: dict | None = None, overwrite: bool = True) -> None:
    """Writes rows (part, pos, id, meta, content) in the order of pos as one container. pos tells all rows apart."""
    rows.sparkSession.dataSource.register(Containers)
    shaped = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in ("path", "kind", "error")], "part", F.col("pos").cast("int").alias("pos"), "id", "meta", "content")
    shaped.repartitionByRange("pos").sortWithinPartitions("pos").write.format("containers").option("path", path).option("kind", kind).option("meta", json.dumps(meta or {})).mode("overwrite" if overwrite else "append").save()


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with pos: their number by `order`, which a group of stretches gives without one task for all."""
    from dossier.operators.facets import ranked

    return ranked(rows.withColumn("__order", F.struct(*order)), F.lit(0), "__order", "pos").withColumn("pos", F.col("pos") - 1).drop("__order")


def catalogue_rows(tools: DataFrame, photos: DataFrame) -> DataFrame:
    """(part, pos, id, meta, content) of a tool catalogue: all tools in order of id, then the photos that they name, each
    once. A photo that is not there is left out."""
    told = tools.select(F.lit(0).alias("o"), F.lit("tool").alias("part"), "id", F.to_json(F.struct(*tools.columns)).alias("meta"), F.lit(None).cast("binary").alias("content"))
    named = tools.where("photo is not null and photo <> ''").select(F.col("photo").alias("__p")).distinct()
    shown = photos.join(named, F.col("id") == F.col("__p"), "left_semi").groupBy("id").agg(F.min("blob").alias("blob")).where("blob is not null")
    rows = told.union(shown.select(F.lit(1), F.lit("photo"), "id", F.lit(None).cast("string"), F.col("blob")))
    return _numbered(rows, "o", "id").drop("o")


def vault_rows(files: DataFrame, blobs: DataFrame, thumbs: DataFrame) -> DataFrame:
    """(part, pos, id, meta, content) of a vault: each live file's bytes, then its preview if it has one, in order of id."""
    from dossier.operators.relations import with_bytes

    held = with_bytes(files.where("deletedAt is null"), blobs, thumbs).where("blob is not null")
    meta = F.to_json(F.struct(*[c for c in files.columns if c != "size"]))
    rows = held.select(F.lit(0).alias("o"), F.lit("blob").alias("part"), "id", meta.alias("meta"), F.col("blob").alias("content"))
    rows = rows.union(held.where("octet_length(thumb) > 0").select(F.lit(1), F.lit("thumb"), "id", F.lit(None).cast("string"), F.col("thumb")))
    return _numbered(rows, "id", "o").drop("o")
