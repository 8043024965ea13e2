"""Container files as tables: backups (fdb), vaults (fvault), tool catalogues (tidb), document zips (lidb), plain zips.

Files come from Spark's binaryFile source, one row each. A file is checked whole before any of its rows comes out; a bad
one gives a single row with its error code. Spark's binary values end at 2 GB, and so do these files; `sources.bytes` reads
and writes larger ones by ranges.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The magic of each kind and its version. A header also names its format, which readers only need to find there.
MAGIC = {"fdb": (b"FDBK", 1), "fvault": (b"FVLT", 2), "tidb": (b"TIDB", 1)}

ROWS = "path string, kind string, error string, part string, pos int, id string, meta string, content binary"


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def sniff(content: Column) -> Column:
    """The kind by the first bytes, whatever the name; null if unknown."""
    head = F.substring(content, 1, 4)
    is_ = lambda b: F.hex(head).startswith(b.hex().upper())
    out = F.when(is_(b"FVLT"), "fvault").when(is_(b"TIDB"), "tidb").when(is_(b"FDBK"), "fdb").when(is_(b"PK"), "zip")
    return out.when(is_(b"{") | is_(b"\xef"), "json")


def header_of(head: bytes, more, size: int, kind: str) -> tuple[dict, int]:
    """(header, where the payloads begin) of a container of `size` bytes, from its first 12 and more(n), the n after them."""
    magic, version = MAGIC[kind]
    if head[:4] != magic:
        raise ValueError("BAD_MAGIC")
    if len(head) < 12 or struct.unpack_from("<I", head, 4)[0] != version:
        raise ValueError("BAD_VERSION")
    n = struct.unpack_from("<I", head, 8)[0]
    if not n or 12 + n > size:
        raise ValueError("BAD_METADATA_LENGTH")
    try:
        meta = json.loads(more(n).decode("utf-8"))
    except ValueError:
        raise ValueError("BAD_METADATA") from None
    if not isinstance(meta, dict) or not isinstance(meta.get("format"), str) or not meta["format"]:
        raise ValueError("BAD_METADATA")
    return meta, 12 + n


def layout_of(meta: dict, kind: str, size: int) -> list[tuple]:
    """(part, pos, id, meta json, bytes; null: none) of what a header names, in the order of the file, checked against the
    `size` bytes that there are for payloads."""
    out: list[tuple] = []
    sizes: list[tuple] = []
    try:
        if kind == "fdb":
            out += [("record:" + store, k, r.get("id", r.get("vin", r.get("key"))), json.dumps(r), None) for store, rs in meta["records"].items() for k, r in enumerate(rs)]
            sizes = [("payload:" + p["store"], p["id"], p, p["len"], "TRUNCATED_PAYLOAD") for p in meta["payloads"]]
        elif kind == "tidb":
            out += [("tool", k, t.get("id"), json.dumps(t), None) for k, t in enumerate(meta["tools"])]
            sizes = [("photo", p["id"], p, p["len"], "TRUNCATED_PAYLOAD") for p in meta.get("photos", [])]
        else:
            for f in meta["files"]:
                if f.get("size") is not None and f["size"] != f["blobLen"]:
                    raise ValueError("SIZE_MISMATCH")
                sizes += [("blob", f["id"], f, f["blobLen"], "TRUNCATED_BLOB"), ("thumb", f["id"], None, f.get("thumbLen") or 0, "TRUNCATED_THUMB")]
    except (KeyError, TypeError, AttributeError):
        raise ValueError("BAD_METADATA") from None
    at = 0
    for k, (part, id_, m, n, code) in enumerate(sizes):
        if not isinstance(n, int) or n < 0 or at + n > size:
            raise ValueError(code)
        out.append((part, k, id_, None if m is None else json.dumps(m), n))
        at += n
    if at != size:
        raise ValueError("TRAILING_BYTES")
    return out


def parse(data: bytes, kind: str) -> list[tuple]:
    """(part, pos, id, meta json, content) rows of one container; raises ValueError with the error code."""
    if kind in ("zip", "lidb"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                entries = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
        except (zipfile.BadZipFile, NotImplementedError, EOFError):
            raise ValueError("BAD_ZIP") from None
        if kind == "zip":
            return [("entry", k, name, None, body) for k, (name, body) in enumerate(entries)]
        listing = dict(entries).get("manifest.json")
        if listing is None:
            raise ValueError("NO_MANIFEST")
        named = {d.get("fname"): d for d in json.loads(listing).get("docs", [])}
        inside = [(n, b) for n, b in entries if n.startswith("files/")]
        return [("document", k, named.get(n[6:], {}).get("id"), json.dumps(named.get(n[6:], {})), b) for k, (n, b) in enumerate(inside)]
    meta, at = header_of(data[:12], lambda n: data[12 : 12 + n], len(data), kind)
    out = []
    for part, pos, id_, m, n in layout_of(meta, kind, len(data) - at):
        if part != "thumb" or n:
            out.append((part, pos, id_, m, None if n is None else data[at : at + n]))
        at += n or 0
    return out


def read(found: DataFrame, kind: str | None = None) -> DataFrame:
    """ROWS of every container in a binaryFile table (path, content); kind: by content if not given (zips as plain zips)."""

    def run(batches):
        for rows in batches:
            for path, k, content in zip(rows["path"], rows["kind"], rows["content"]):
                try:
                    if k in (None, "json"):
                        raise ValueError("UNKNOWN_FORMAT")
                    parts = [(path, k, None, *p) for p in parse(bytes(content), k)]
                except ValueError as e:
                    parts = [(path, k, str(e), None, None, None, None, None)]
                yield pd.DataFrame(parts, columns=["path", "kind", "error", "part", "pos", "id", "meta", "content"])

    rows = found.select("path", (F.lit(kind) if kind else sniff(F.col("content"))).alias("kind"), "content")
    return rows.mapInPandas(run, ROWS)


def legacy_vault(found: DataFrame) -> DataFrame:
    """(path, error, pos, id, name, content) of JSON vaults of a binaryFile table, whose bytes are base64 within. Records
    without bytes are skipped; a file that is no such vault gives one row with its error."""
    shape = "format string, files array<struct<id:string,name:string,blob:string>>"
    meta = F.from_json(F.decode("content", "utf-8"), shape)
    rows = found.select("path", meta.alias("m")).withColumn("ok", F.coalesce((F.col("m.format") != "") & F.col("m.files").isNotNull(), F.lit(False)))
    good = rows.where("ok").select("path", F.posexplode("m.files").alias("pos", "f")).where("f.blob <> ''")
    good = good.select("path", F.lit(None).cast("string").alias("error"), "pos", "f.id", "f.name", F.try_to_binary("f.blob", F.lit("base64")).alias("content"))
    none = F.lit(None)
    bad = rows.where("not ok").select("path", F.lit("BAD_METADATA"), none.cast("int"), none.cast("string"), none.cast("string"), none.cast("binary"))
    return good.union(bad)


def loose(found: DataFrame) -> DataFrame:
    """(path, pos, id, name, content) of binary vaults: lengths are trusted, thumbnails skipped, nothing is checked. Bytes are
    cut where running sums of the lengths say."""
    size = F.conv(F.hex(F.reverse(F.substring("content", 9, 4))), 16, 10).cast("int")
    shape = "files array<struct<id:string,name:string,blobLen:long,thumbLen:long>>"
    rows = found.select("path", "content", size.alias("n")).withColumn("m", F.from_json(F.decode(F.expr("substring(content, 13, n)"), "utf-8"), shape))
    files = rows.select("path", "content", "n", F.posexplode("m.files").alias("pos", "f"))
    held = lambda c: F.coalesce(F.col(c), F.lit(0))
    before = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("n") + 13 + F.coalesce(F.sum(held("f.blobLen") + held("f.thumbLen")).over(before), F.lit(0))
    return files.withColumn("at", at.cast("int")).select("path", "pos", "f.id", "f.name", F.expr("substring(content, at, cast(coalesce(f.blobLen, 0) as int))").alias("content"))


def pack(kind: str, meta: dict, payloads: list[bytes]) -> bytes:
    """One container's bytes: magic, version, header (meta, with its format name), payloads. For exports that one value can hold."""
    magic, version = MAGIC[kind]
    head = json.dumps(meta, ensure_ascii=False).encode()
    return magic + struct.pack("<II", version, len(head)) + head + b"".join(payloads)


def export_paths(files: DataFrame, name: str, folder: str, order: str) -> DataFrame:
    """Adds path: folder and safe name; repeats within a folder are numbered."""
    from dossier.functions.text import clip_name
    from dossier.operators.facets import unique_names

    rows = files.withColumn("__path", F.concat_ws("/", F.nullif(clip_name(F.col(folder)), F.lit("file")), clip_name(F.col(name))))
    return unique_names(rows, "__path", order).withColumnRenamed("unique_name", "path").drop("__path")


def zip_of(files: DataFrame, group: str, path: str, content: str) -> DataFrame:
    """(group, zip): stored entries in order of their paths; one zip per group, of a size that one value can hold."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for p, c in sorted(zip(rows["path"], rows["content"])):
                z.writestr(zipfile.ZipInfo(p, (1980, 1, 1, 0, 0, 0)), bytes(c))
        return pd.DataFrame({"group": [rows["group"].iloc[0]], "zip": [out.getvalue()]})

    rows = files.select(F.col(group).cast("string").alias("group"), F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    return rows.groupBy("group").applyInPandas(build, "group string, zip binary")
