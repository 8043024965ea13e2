"""Relations, lifecycle, stores, containers, jobs, layout, diff: the scenarios of the data layer on small tables."""

import io
import json
import struct
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import diff, facets, layout, lifecycle, relations, search
from dossier.schemas import STORES
from dossier.sources import bytes as byte_ranges
from dossier.sources import containers, csvs
from dossier.sources.store import RevConflict, Store
from dossier.streaming import ingest, intake, jobs


def table(spark, store, *rows):
    """Rows of a store; columns that are not given are null."""
    schema = spark.createDataFrame([], STORES[store]).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def sha(b):
    import hashlib

    return hashlib.sha256(b).hexdigest()


def link(a, ai, b, bi, kind, **more):
    return {"id": f"{a}:{ai}>{b}:{bi}#{kind}", "fromType": a, "fromId": ai, "toType": b, "toId": bi, "kind": kind, **more}


def ids_of(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_shared_bytes_live_until_the_last_holder(spark):
    files = table(spark, "files", {"id": "a"}, {"id": "b", "blobId": "a"}, {"id": "c"})
    blobs = table(spark, "blobs", {"id": "a", "blob": b"x"}, {"id": "c", "blob": b"y"})
    gone = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert ids_of(lifecycle.unused_blobs(files, blobs, gone("a"))) == []
    assert ids_of(lifecycle.unused_blobs(files, blobs, gone("b"))) == []
    assert ids_of(lifecycle.unused_blobs(files, blobs, gone("a", "b"))) == ["a"]
    assert ids_of(relations.without_bytes(files, blobs.where("id = 'c'"))) == ["a", "b"]
    assert ids_of(relations.with_bytes(files, blobs, table(spark, "thumbs")).where("blob is not null")) == ["a", "b", "c"]


def test_purge_keeps_what_is_named(spark):
    files = table(spark, "files", {"id": "a"}, {"id": "b", "docId": "d1"}, {"id": "c"}, {"id": "e"})
    links = table(spark, "links", link("ro", "r1", "file", "a", "attachment"), link("file", "c", "document", "d", "reference"))
    plan = {r.id: (r.purged, r.refs) for r in lifecycle.purge_plan(files, links, files).collect()}
    assert plan == {"a": (False, 1), "b": (False, 1), "c": (False, 1), "e": (True, 0)}
    assert ids_of(lifecycle.cascade_links(links, files.where("id = 'a'"), "file")) == ["file:c>document:d#reference"]


def test_trash_modes_of_an_order(spark):
    links = table(spark, "links", *[link("ro", r, "file", f, "attachment") for r, f in (("r1", "own"), ("r1", "shared"), ("r2", "shared"), ("r1", "old"), ("r3", "old"))])
    ros = table(spark, "ros", {"id": "r1"}, {"id": "r2"}, {"id": "r3", "deletedAt": 5})
    plan = lambda mode: {r.fileId: r.action for r in lifecycle.order_trash_plan(links, ros, "r1", mode).collect()}
    assert plan("trash") == {"own": "trash", "shared": "keep", "old": "trash"}
    assert set(plan("unlink").values()) == {"unlink"}


def test_trash_and_restore_bump_rev(spark):
    files = table(spark, "files", {"id": "a", "rev": 1}, {"id": "b", "rev": 1, "deletedAt": 3, "trashedWith": "r"})
    both = files.select("id")
    t = {r.id: r for r in lifecycle.trash(files, both, 9).collect()}
    assert (t["a"].deletedAt, t["a"].rev, t["b"].deletedAt, t["b"].rev) == (9, 2, 3, 1)
    r = {x.id: x for x in lifecycle.restore(files, both).collect()}
    assert (r["b"].deletedAt, r["b"].trashedWith, r["b"].rev, r["a"].rev) == (None, None, 2, 1)


def test_optimistic_revisions(spark):
    stored = table(spark, "settings", {"key": "k", "value": "1", "rev": 4})
    writes = spark.createDataFrame([("k", "2", 3), ("n", "5", None)], "key string, value string, expectedRev long")
    after, conflicts = lifecycle.put(stored, writes, "key")
    assert {r.key: (r.value, r.rev) for r in after.collect()} == {"k": ("1", 4), "n": ("5", 1)}
    assert [(r.key, r.expectedRev, r.currentRev) for r in conflicts.collect()] == [("k", 3, 4)]
    after, _ = lifecycle.put(stored, writes.withColumn("expectedRev", F.lit(None).cast("long")), "key")
    assert {r.key: r.rev for r in after.collect()} == {"k": 5, "n": 1}


def test_pinned_version_against_the_newest(spark):
    n = "LI54.10-P-071234"
    pins = table(spark, "links", link("ro", "r", "document", "d3", "reference", li=n, ver="3"))
    docs = lambda *v: table(spark, "documents", *[{"id": f"d{k}", "li": n if k % 2 else n.lower(), "ver": str(k)} for k in v])
    got = lambda d: relations.references(pins, d).first()
    assert got(docs(3)).newer is False
    assert (got(docs(3, 4)).newer, got(docs(3, 4)).latestId) == (True, "d4")
    lost = got(docs(4))
    assert (lost.docId, lost.ver, lost.newer) == (None, "3", True)


def test_vehicle_summary(spark):
    v = table(spark, "vehicles", {"vin": "W1K2140471A068698", "series": "214"})
    files = table(spark, "files", *[{"id": i, "inFiles": n, "deletedAt": d, "vins": ["W1K2140471A068698"], "updatedAt": u} for i, n, d, u in (("f1", 1, None, 3), ("f2", 1, 5, 2), ("f3", 0, None, 1))])
    ros = table(spark, "ros", {"id": "r1", "vin": "w1k2140471a068698", "updatedAt": 1}, {"id": "r2", "vin": "W1K2140471A068698", "deletedAt": 4})
    docs = table(spark, "documents", {"id": "d1", "validity": "Model 214"}, {"id": "d2", "validity": "205, 213"})
    tools = table(spark, "tools", {"id": "t1", "validities": ["213, 214"]}, {"id": "t2", "validities": ["2140"]})
    got = relations.vehicle_summary(v, files, ros, docs, tools).first()
    assert (got.n_files, got.n_ros, got.n_documents, got.n_tools, got.files) == (1, 1, 1, 1, ["f1"])


def test_search_over_four_stores(spark):
    files = lifecycle.prepare_files(table(spark, "files", {"id": "f1", "name": "Brake.pdf", "updatedAt": 2}, {"id": "f2", "name": "brake", "deletedAt": 1}, {"id": "f3", "name": "brake", "inFiles": 0}), 7)
    assert ids_of(search.files(files, "BRAKE")) == ["f1"]
    assert {r.id: r.kind for r in files.collect()}["f1"] == "pdf"
    n = "LI54.10-P-071234"
    docs = table(spark, "documents", {"id": "a1", "li": n, "ver": "1", "title": "brake"}, {"id": "a2", "li": n, "ver": "2", "title": "brake"}, {"id": "b", "title": "other"})
    assert ids_of(search.documents(docs, "brake")) == ["a2"] == ids_of(search.documents(docs, "5410p07"))
    tools = table(spark, "tools", {"id": "t1", "toolNo": "000 589 01 23 00"})
    assert ids_of(search.tools(tools, "0005890123")) == ["t1"] and search.tools(tools, "58 01 zz").count() == 0
    ros = table(spark, "ros", {"id": "r1", "lines": [("l", "brake squeal", "B1")]}, {"id": "r2", "scanText": "brake", "deletedAt": 2})
    assert ids_of(search.orders(ros, "squeal b1")) == ["r1"]
    assert search.tokens("A‑b c") == ["a-b", "c"]
    found = search.federated({"files": search.files(files, "brake"), "tools": search.tools(tools, "nothing")}, {"files": F.col("name"), "tools": F.col("desc")})
    assert [(r.store, r.id) for r in found.collect()] == [("files", "f1")]
    asked = spark.createDataFrame([("000 589 01 23 00",), ("W1NKM4GB9SF382775",), (n.lower(),), ("hello",)], "q string")
    assert [r.r for r in asked.select(search.route(F.col("q")).alias("r")).collect()] == ["tool", "vehicle", "document", "text"]


def test_version_groups_by_canonical_number(spark):
    spellings = ["LI54.10-P-071234", "LI54.10‑P‑071234", " LI54.10-P-071234 ", "li54.10-p-071234", "LI54.10 ‑P-071234".replace(" ‑", "-")]
    docs = table(spark, "documents", *[{"id": f"d{k}", "li": x, "ver": str(k)} for k, x in enumerate(spellings)], {"id": "x"}, {"id": "y"})
    groups = {r.key: r for r in facets.version_groups(docs).collect()}
    assert len(groups) == 3 and [v.ver for v in groups["li:LI54.10-P-071234"].versions] == ["4", "3", "2", "1", "0"]
    assert groups["id:x"].needsReview


def test_upserts_and_merges(spark):
    stored = table(spark, "tools", {"id": "t4", "toolNo": "A", "desc": "old", "note": "keep"})
    new = spark.createDataFrame([(None, "A", "new", " ", 0), (None, "B", "b", "", 1)], "id string, toolNo string, desc string, note string, pos int")
    got = {r.id: (r.toolNo, r.desc, r.note) for r in lifecycle.upsert_tools(stored, new, ["toolNo", "desc", "note"]).collect()}
    assert got["t4"] == ("A", "new", "keep") and got["t5"][0] == "B"
    kept = lifecycle.keep_edited(table(spark, "documents", {"id": "d", "title": "mine", "reason": "r", "edited": {"title": 1}}), spark.createDataFrame([("d", "theirs", "s")], "id string, title string, reason string")).first()
    assert (kept.title, kept.reason) == ("mine", "s")
    order = table(spark, "ros", {"id": "r", "ro": "", "vin": "V", "lines": [("1", "oil  change", ""), ("2", "", "")]})
    scan = spark.createDataFrame([("r", "77", "W", [("3", "OIL CHANGE", ""), ("4", "wash", "W")])], "id string, ro string, vin string, lines array<struct<id:string,text:string,op:string>>")
    m = lifecycle.merge_scan(order, scan).first()
    assert (m.ro, m.vin, [x.id for x in m.lines]) == ("77", "V", ["1", "4"])
    v = lifecycle.note_vehicles(table(spark, "vehicles", {"vin": "W1NKM4GB9SF382775", "model": "E", "sources": ["a"], "confirmedAt": 1}), spark.createDataFrame([("w1nkm4gb9sf382775", "F", "X", "b"), ("bad", None, None, "b")], "vin string, fin string, model string, source string"), 5).collect()
    assert [(r.vin, r.fin, r.model, r.sources, r.status) for r in v] == [("W1NKM4GB9SF382775", "F", "E", ["a", "b"], "confirmed")]
    stars = lifecycle.toggle_stars(table(spark, "files", {"id": "a", "starred": True}, {"id": "b", "starred": False}), spark.createDataFrame([("a",), ("b",)], "id string"))
    assert all(r.starred for r in stars.collect())


def test_intake_reuses_known_bytes(spark):
    files = table(spark, "files", {"id": "a", "deletedAt": 3}, {"id": "b"})
    blobs = table(spark, "blobs", {"id": "a", "sha256": "s1"}, {"id": "b", "sha256": "s2"})
    new = spark.createDataFrame([("n1", "s1"), ("n2", "s2"), ("n3", "s3")], "id string, sha256 string")
    got = {r.id: (r.holder, r.action, r.revive) for r in lifecycle.intake_decisions(new, files, blobs, "reuse").collect()}
    assert got == {"n1": ("a", "reuse", True), "n2": ("b", "reuse", False), "n3": (None, "new", False)}


def test_generations(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.generation() == 0 and store.read("files").count() == 0
    body = b"bytes"
    assert store.commit({"files": table(spark, "files", {"id": "a", "name": "x"}), "blobs": table(spark, "blobs", {"id": "a", "blob": body, "sha256": sha(body)})}) == 1
    with pytest.raises(ValueError, match="wrong hash"):
        store.commit({"blobs": table(spark, "blobs", {"id": "a", "blob": b"tampered", "sha256": sha(body)})})
    with pytest.raises(ValueError, match="without bytes"):
        store.commit({"blobs": table(spark, "blobs")})
    assert not (tmp_path / "store/gen=2").exists()
    assert store.generation() == 1 and store.read("files").first().name == "x"
    old = store.read("files")
    store.commit({"files": lifecycle.trash(old, old, 5)})
    assert {r.store: r.n for r in store.counts().collect()}["files"] == 1 and store.read("files").first().deletedAt == 5
    log = ingest.change_log(store.read("files", 1), store.read("files"))
    assert [(r.id, r.op) for r in log.collect()] == [("a", "put")]
    with pytest.raises(ValueError):
        store.drop(2)
    store.drop(1)
    # The bytes were written by generation 1 and never again: the live one still reads them from there.
    assert store.read("blobs").count() == 1 and not (tmp_path / "store/gen=2/blobs").exists() and not (tmp_path / "store/gen=1/files").exists()


def test_writes_follow_the_change(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    bodies = spark.range(4000).select(F.format_string("f%05d", "id").alias("id"), F.format_string("file %d", "id").alias("name"), F.encode(F.repeat(F.format_string("%d,", "id"), 50), "utf-8").alias("blob"), F.lit(None).cast("binary").alias("thumb"))
    store.put_full(bodies, 5)
    first = sum(f.stat().st_size for f in (tmp_path / "store/gen=1").rglob("*.parquet"))
    one = bodies.where("id = 'f00007'").withColumns({"name": F.lit("renamed"), "blob": F.lit("new bytes").cast("binary"), "thumb": F.lit("t").cast("binary")})
    assert store.put_full(one, 6) == 2
    second = sum(f.stat().st_size for f in (tmp_path / "store/gen=2").rglob("*.parquet"))
    assert second < first / 20
    row = store.get("files", ["f00007"]).first()
    assert (row.name, row.rev, row.size) == ("renamed", 2, 9) and store.read("files").count() == 4000
    assert bytes(store.get("blobs", ["f00007"]).first().blob) == b"new bytes" and store.read("thumbs").count() == 1
    assert store.get("files", ["f00007"], generation=1).first().name == "file 7" and store.get("files", ["none"]).count() == 0
    with pytest.raises(ValueError, match="without bytes"):
        store.remove("blobs", spark.createDataFrame([("f00009",)], "id string"))
    store.apply(gone={n: spark.createDataFrame([("f00009",), ("f00007",)], "id string") for n in ("files", "blobs", "thumbs")})
    assert store.read("files").count() == 3998 and store.get("files", ["f00007", "f00008", "f00009"]).select("id").collect()[0].id == "f00008"
    before = store.read("files").orderBy("id").collect()
    n = store.compact()
    assert [len(p) for p in store.parts().values()] == [1, 1, 1] and store.read("files").orderBy("id").collect() == before
    for old in range(1, n):
        store.drop(old)
    assert store.read("blobs").count() == 3998 and {p.name for p in (tmp_path / "store").glob("gen=*") if any(p.rglob("*.parquet"))} == {f"gen={n}"}


def test_revisions_guard_against_lost_updates(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    put = lambda desc, rev=None: store.put("tools", spark.createDataFrame([("t1", "000 589 01 23 00", desc, rev)], "id string, toolNo string, desc string, expectedRev long"))
    put("wrench")
    assert store.get("tools", ["t1"]).first().rev == 1
    put("wrench!", 1)
    with pytest.raises(RevConflict) as e:
        put("stale", 1)
    assert e.value.rows[0].currentRev == 2 and store.generation() == 2
    assert (store.get("tools", ["t1"]).first().desc, store.get("tools", ["t1"]).first().rev) == ("wrench!", 2)
    with pytest.raises(ValueError, match="one key"):
        store.put("tools", spark.createDataFrame([("t2", "a"), ("t2", "b")], "id string, desc string"))
    many = spark.range(3000).select(F.format_string("t%d", "id").alias("id"), F.lit("x").alias("desc"))
    store.put("tools", many)
    assert store.read("tools").count() == 3000 and store.get("tools", ["t1", "t5"]).orderBy("id").select("rev").collect() == [(3,), (1,)]
    store.apply({"log": spark.createDataFrame([(5, "e"), (12, "w")], "id long, msg string")})
    assert store.get("log", [12]).first().msg == "w" and store.get("log", [7]).count() == 0


def test_keys_prune_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with_files = spark.range(200_000).select(F.format_string("s%06d", "id").alias("key"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 20).alias("value"), F.lit(1).cast("long").alias("rev"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.commit({"settings": with_files})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = len(list((tmp_path / "store/gen=1/settings").glob("*.parquet")))
    store.put("settings", spark.createDataFrame([("s000500", "new")], "key string, value string"))
    assert files >= 4
    for key, parts in (("s000500", 2), ("s150000", 1)):  # one file of the whole table, and the changes if their range holds the key
        got = store.get("settings", [key])
        assert len(got.inputFiles()) == parts and got.count() == 1
    assert store.get("settings", ["s000500"]).first().value == "new"


def test_restore(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    files = spark.createDataFrame([("f1", "a.txt", b"AAAA", b"t"), ("f2", "b.txt", b"BB", None)], "id string, name string, blob binary, thumb binary")
    store.put_full(files, 1)
    store.put("ros", spark.createDataFrame([("r1", "42")], "id string, ro string"))
    backup = {k: spark.createDataFrame(v.collect(), STORES[k]) for k, v in store.snapshot().items()}
    counts = {k: v.count() for k, v in backup.items()}
    live = store.generation()
    torn = backup | {"blobs": backup["blobs"].where("id = 'f1'")}
    tampered = backup | {"blobs": backup["blobs"].withColumn("blob", F.concat("blob", F.lit("!").cast("binary")))}
    for bad, expected, said in ((torn, None, "without bytes"), (tampered, None, "wrong hash"), (backup, counts | {"ros": 2}, "instead of 2")):
        with pytest.raises(ValueError, match=said):
            store.restore(bad, expected)
        assert store.generation() == live and store.get("blobs", ["f1"]).count() == 1 and not (tmp_path / f"store/gen={live + 1}").exists()
    n = store.restore(backup, counts, 77)
    assert store.generation() == n and bytes(store.get("blobs", ["f1"]).first().blob) == b"AAAA" and store.get("ros", ["r1"]).first().ro == "42"
    assert store.get("settings", ["backup.restored"]).first().value == "77" and {r.store: r.n for r in store.counts().collect()}["files"] == 2
    assert [p.name for p in (tmp_path / "store").glob("gen=*") if any(p.rglob("*.parquet"))] == [f"gen={n}"]


def container(kind, meta, *payloads):
    return containers.pack(kind, {"format": f"a {kind} file", **meta}, list(payloads))


GOOD = {
    "fdb": container("fdb", {"records": {"files": [{"id": "a"}]}, "payloads": [{"store": "blobs", "id": "a", "len": 2}]}, b"xy"),
    "fvault": container("fvault", {"files": [{"id": "a", "size": 2, "blobLen": 2, "thumbLen": 1}]}, b"xy", b"t"),
    "tidb": container("tidb", {"tools": [{"id": "t1"}], "photos": [{"id": "p", "len": 3}]}, b"pic"),
}


@pytest.mark.parametrize(
    "data, kind, code",
    [
        (b"NOPE" + GOOD["fdb"][4:], "fdb", "BAD_MAGIC"),
        (b"FDBK" + struct.pack("<I", 9) + GOOD["fdb"][8:], "fdb", "BAD_VERSION"),
        (GOOD["fdb"][:8] + struct.pack("<I", 1 << 30) + GOOD["fdb"][12:], "fdb", "BAD_METADATA_LENGTH"),
        (GOOD["fdb"][:12] + b"{" * (len(GOOD["fdb"]) - 14) + b"xy", "fdb", "BAD_METADATA"),
        (GOOD["fdb"][:-1], "fdb", "TRUNCATED_PAYLOAD"),
        (GOOD["fdb"] + b"!", "fdb", "TRAILING_BYTES"),
        (GOOD["fvault"][:-2], "fvault", "TRUNCATED_BLOB"),
        (GOOD["fvault"][:-1], "fvault", "TRUNCATED_THUMB"),
        (container("fvault", {"files": [{"id": "a", "size": 3, "blobLen": 2}]}, b"xy"), "fvault", "SIZE_MISMATCH"),
        (b"PKnozip", "zip", "BAD_ZIP"),
    ],
)
def test_bad_containers(data, kind, code):
    with pytest.raises(ValueError, match=code):
        containers.parse(data, kind)


def test_containers_as_tables(spark, tmp_path):
    for kind, data in GOOD.items():
        (tmp_path / f"{kind}.bin").write_bytes(data)
    (tmp_path / "bad.bin").write_bytes(GOOD["fdb"][:-1])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("manifest.json", json.dumps({"v": 1, "docs": [{"id": "d1", "fname": "x.pdf"}]}))
        z.writestr("files/x.pdf", b"pdf")
    (tmp_path / "l.lidb").write_bytes(out.getvalue())
    rows = containers.read(containers.files(spark, str(tmp_path))).collect()
    by = lambda k: [(r.part, r.id, bytes(r.content) if r.content is not None else None) for r in rows if r.path.endswith(k)]
    assert by("fdb.bin") == [("record:files", "a", None), ("payload:blobs", "a", b"xy")]
    assert by("fvault.bin") == [("blob", "a", b"xy"), ("thumb", "a", b"t")] and by("tidb.bin")[1] == ("photo", "p", b"pic")
    assert [r.error for r in rows if r.path.endswith("bad.bin")] == ["TRUNCATED_PAYLOAD"]
    assert len(by("l.lidb")) == 2
    docs = containers.read(containers.files(spark, str(tmp_path / "l.lidb")), "lidb").collect()
    assert [(r.part, r.id) for r in docs] == [("document", "d1")]
    zipped = containers.zip_of(spark.createDataFrame([("g", "b", b"2"), ("g", "a", b"1")], "g string, p string, c binary"), "g", "p", "c").first()
    with zipfile.ZipFile(io.BytesIO(zipped.zip)) as z:
        assert z.namelist() == ["a", "b"] and z.read("a") == b"1"


def test_container_ranges(spark, tmp_path):
    """The data source gives the rows of the one-value reader, in many tasks, and the same error codes."""
    spark.dataSource.register(byte_ranges.Containers)
    rng = np.random.default_rng(5)
    bodies = [rng.bytes(int(n)) for n in rng.integers(0, 3000, 300)]
    big = container("fdb", {"records": {"files": [{"id": f"f{k}"} for k in range(300)]}, "payloads": [{"store": "blobs", "id": f"f{k}", "len": len(b)} for k, b in enumerate(bodies)]}, *bodies)
    found = {"big": big, **GOOD, "short": GOOD["fdb"][:-1], "long": GOOD["tidb"] + b"!", "json": b"{}", "empty": b"", "torn": GOOD["fvault"][:-1]}
    (tmp_path / "sub").mkdir()
    for k, (name, data) in enumerate(found.items()):
        (tmp_path / ("sub" if k % 2 else ".") / name).write_bytes(data)
    got = spark.read.format("containers").option("path", str(tmp_path)).option("range", 20_000).load()
    assert got.rdd.getNumPartitions() > 20
    key = lambda r: (r.path.rsplit("/", 1)[1], r.kind if r.kind != "json" else None, r.error, r.part, r.pos, r.id, r.meta, None if r.content is None else bytes(r.content))
    want = containers.read(containers.files(spark, str(tmp_path)).where("length > 0")).collect()
    assert sorted(map(key, got.where("path not like '%/empty'").collect()), key=str) == sorted(map(key, want), key=str)
    assert got.where("path like '%/empty'").first().error == "UNKNOWN_FORMAT"
    assert got.where("part = 'payload:blobs' and path like '%/big'").agg(F.sum(F.octet_length("content"))).first()[0] == sum(map(len, bodies))


@pytest.mark.parametrize("case", range(10))
def test_container_ranges_have_all_codes(spark, tmp_path, case):
    data, kind, code = test_bad_containers.pytestmark[0].args[1][case]
    (tmp_path / "x").write_bytes(data)
    error = byte_ranges._Reader(str(tmp_path / "x"), kind if kind != "zip" else None, 1).partitions()[0].error
    assert error == (code if kind != "zip" else "UNKNOWN_FORMAT")


def test_a_file_of_five_gigabytes_is_many_ranges(tmp_path):
    """Its payloads are a hole in the file: only its header is read while the scan is planned."""
    n = 640
    meta = json.dumps({"format": "x", "records": {}, "payloads": [{"store": "blobs", "id": f"b{k}", "len": 8 << 20} for k in range(n)]}).encode()
    with open(tmp_path / "large.fdb", "wb") as f:
        f.write(b"FDBK" + struct.pack("<II", 1, len(meta)) + meta)
        f.truncate(12 + len(meta) + n * (8 << 20))
    began = time.time()
    ranges = byte_ranges._Reader(f"file://{tmp_path}/large.fdb", None, byte_ranges.RANGE).partitions()
    assert len(ranges) == n // 8 and all(r.error is None and len(r.rows) == 8 for r in ranges) and time.time() - began < 5
    assert sum(len(b) for b in byte_ranges._Reader(f"file://{tmp_path}/large.fdb", None, byte_ranges.RANGE).read(ranges[-1])) == 8


def test_containers_are_written_in_parts(spark, tmp_path):
    files = table(spark, "files", *[{"id": f"f{k}", "name": f"n{k}", "size": 1, "blobId": "f1" if k == 5 else None, "deletedAt": 3 if k == 7 else None} for k in range(40)])
    blobs = table(spark, "blobs", *[{"id": f"f{k}", "blob": bytes([k]) * (k % 9)} for k in range(40) if k not in (5, 9)])
    thumbs = table(spark, "thumbs", {"id": "f3", "blob": b"tt"}, {"id": "f4", "blob": b""})
    rows = byte_ranges.vault_rows(files, blobs, thumbs).repartition(5)
    byte_ranges.write(rows, str(tmp_path / "v.fvault"), "fvault", {"made": "by test"})
    got = containers.parse((tmp_path / "v.fvault").read_bytes(), "fvault")
    assert [(p, i, c) for p, _, i, _, c in got] == [x for k in sorted(f"f{k}" for k in range(40) if k not in (7, 9)) for x in ([("blob", k, bytes([1 if k == "f5" else int(k[1:])]) * (1 if k == "f5" else int(k[1:]) % 9))] + ([("thumb", k, b"tt")] if k == "f3" else []))]
    tools = table(spark, "tools", {"id": "t2", "photo": "p1", "toolNo": "7"}, {"id": "t1", "photo": "p1"}, {"id": "t3", "photo": "gone"}, {"id": "t4"})
    photos = table(spark, "photos", {"id": "p1", "blob": b"first"}, {"id": "p9", "blob": b"not named"})
    byte_ranges.write(byte_ranges.catalogue_rows(tools, photos), f"file://{tmp_path}/c.tidb", "tidb")
    spark.dataSource.register(byte_ranges.Containers)
    back = spark.read.format("containers").option("path", f"file://{tmp_path}/c.tidb").load().orderBy("part", "pos").collect()
    assert [(r.part, r.id) for r in back] == [("photo", "p1"), ("tool", "t1"), ("tool", "t2"), ("tool", "t3"), ("tool", "t4")] and bytes(back[0].content) == b"first"
    records = spark.createDataFrame([("record:ros", 0, "r1", '{"id":"r1"}', None), ("payload:blobs", 1, "a", None, b"xyz")], "part string, pos int, id string, meta string, content binary")
    byte_ranges.write(records, str(tmp_path / "b.fdb"), "fdb")
    assert [(p, i, c) for p, _, i, _, c in containers.parse((tmp_path / "b.fdb").read_bytes(), "fdb")] == [("record:ros", "r1", None), ("payload:blobs", "a", b"xyz")]
    with pytest.raises(Exception, match="FileExists"):
        byte_ranges.write(records, str(tmp_path / "b.fdb"), "fdb", overwrite=False)
    assert not list(tmp_path.glob("*.parts")) and not list(tmp_path.glob("*.new"))


def test_csv_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name;;n\n"x;""y""";1;2;3\nz\n', newline="")
    got = csvs.read(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["name", "Column 2", "n", "Column 4"]
    assert sorted(tuple(r) for r in got.collect()) == [('x;"y"', "1", "2", "3"), ("z", "", "", "")]
    assert csvs.any_column_has(got, 'Y"').count() == 1
    (tmp_path / "b.csv").write_text("x,y\n1,2\nx,y\n3,4\n", newline="")
    assert sorted(tuple(r) for r in csvs.read(spark, str(tmp_path / "b.csv")).collect()) == [("1", "2"), ("3", "4"), ("x", "y")]
    assert csvs.without_blank_rows(spark.createDataFrame([(" ", None), ("a", "")], "a string, b string")).count() == 1
    line = spark.createDataFrame([("a,b", 'q"', "l\nm", None)], "a string, b string, c string, d string").select(csvs.line(*map(F.col, "abcd")).alias("x")).first().x
    assert line == '"a,b","q""","l\nm",'
    csvs.write(got, str(tmp_path / "out"))
    again = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "out")).fillna("")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def plain_records(text, sep, any_line_end=False):
    """One character after the other."""
    if any_line_end:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    rows, row, cell, quoted, k = [], [], "", False, 0
    while k < len(text):
        c = text[k]
        if quoted and c == '"' and text[k + 1 : k + 2] == '"':
            cell, k = cell + '"', k + 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == sep:
            row, cell = [*row, cell], ""
        elif not quoted and c == "\n":
            rows, row, cell = [*rows, [*row, cell]], [], ""
        elif quoted or c != "\r":
            cell += c
        k += 1
    if cell or row:
        rows.append([*row, cell.removesuffix("\n") if quoted else cell])
    return rows[:-1] if rows and rows[-1] == [""] else rows


@pytest.mark.parametrize("any_line_end", [False, True])
def test_csv_records_over_byte_ranges(spark, tmp_path, any_line_end):
    """Quoted line ends, separators and quotes anywhere, cut into ranges of 64 bytes."""
    import random

    rng = random.Random(6)
    texts = {}
    for k in range(6):
        sep = ",;|"[k % 3]
        texts[k] = "".join(rng.choice(["a", "bc ", sep, sep, '"', '"x\ny"', '""', '"q""q"', "\n", "\n", "\r\n", "é", f'"{sep}\n\r\n{sep}"', "long text " * 5]) for _ in range(400))
    texts[6], texts[7] = "", 'a,b\n"never closed,\n\nx'
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        for k, text in texts.items():
            (tmp_path / f"{k}.csv").write_text(text, newline="")
            sep = ",;|"[k % 3] if k < 6 else ","
            got = csvs.records(spark, str(tmp_path / f"{k}.csv"), sep, any_line_end)
            assert [r.cells for r in got.orderBy("pos").collect()] == plain_records(text, sep, any_line_end)
            if 0 < k < 6:
                assert spark.read.text(str(tmp_path / f"{k}.csv")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parts_and_names(spark):
    df = spark.createDataFrame([("g", k, s) for k, s in enumerate([60, 50, 30, 200, 10])], "g string, o int, s int")
    assert [r.part for r in facets.parts_by_size(df, "g", "o", "s", 100).orderBy("order").collect()] == [0, 1, 1, 2, 3]
    assert [r.part for r in facets.parts_by_count(df, "g", "o", 2).orderBy("o").collect()] == [0, 0, 1, 1, 2]
    assert [r.offset for r in facets.running_offsets(df, "g", "o", "s").orderBy("o").collect()] == [0, 60, 110, 140, 340]
    names = spark.createDataFrame([(1, "a.pdf"), (2, "A.pdf"), (3, "b")], "o int, n string")
    assert [r.unique_name for r in facets.unique_names(names, "n", "o").orderBy("o").collect()] == ["a.pdf", "A (2).pdf", "b"]
    lines = spark.createDataFrame([("d", 1, 0.95, "Footer page 1"), ("d", 2, 0.951, "Footer page 2"), ("d", 1, 0.1, "body text"), ("d", 2, 0.5, "body text")], "doc string, page int, ry double, text string")
    assert [r.signature for r in facets.banded_furniture(lines).collect()] == ["footer page #"]
    assert facets.furniture(lines, "doc", "page", "text").count() == 2
    votes = spark.createDataFrame([("a", 0, "W1NKMAGB9SF382775"), ("a", 1, "W1NKMAGB9SF382775"), ("a", 2, "W1NKM4GB9SF382775"), ("b", 0, "x"), ("b", 1, "y"), ("b", 2, "y")], "key string, pos int, vin string")
    assert {r.key: r.vin for r in relations.pick_vin(votes).collect()} == {"a": "W1NKM4GB9SF382775", "b": "y"}


def test_jobs(spark):
    q = lambda **k: {"type": "ocr", "state": "queued", "attempts": 0, "createdAt": 1, **k}
    df = jobs.claim(table(spark, "jobs", q(id="b", createdAt=2), q(id="a"), q(id="c", type="scan")), "me", 10)
    assert sorted(r.id for r in df.where("state = 'running' and owner = 'me' and attempts = 1").collect()) == ["a", "c"]
    late = jobs.requeue_stale(table(spark, "jobs", q(id="r", state="running", heartbeat=1, attempts=1), q(id="f", state="running", heartbeat=1, attempts=5), q(id="x", state="cancelling", heartbeat=1), q(id="ok", state="running", heartbeat=95_000)), 100_000)
    assert {r.id: r.state for r in late.collect()} == {"r": "queued", "f": "failed", "x": "cancelled", "ok": "running"}
    some = table(spark, "jobs", q(id="q"), q(id="r", state="running", attempts=1), q(id="d", state="done", finishedAt=1))
    assert {r.id: r.state for r in jobs.cancel(some, some.select("id")).collect()} == {"q": "cancelled", "r": "cancelling", "d": "done"}
    out = spark.createDataFrame([("r", False, None, "boom", True)], "id string, ok boolean, result string, error string, retry boolean")
    assert {r.id: r.state for r in jobs.finish(some, out, 9).collect()}["r"] == "queued"
    assert {r.id: r.state for r in jobs.finish(some, out.withColumn("retry", F.lit(False)), 9).collect()}["r"] == "failed"
    assert sorted(r.id for r in jobs.sweep(some, 10**9).collect()) == ["q", "r"]
    assert jobs.enqueue(some, spark.createDataFrame([("n", "ocr")], "id string, type string"), 4).where("state = 'queued'").count() == 2


def test_folder_stream(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.txt").write_text("hello")
    seen = []
    q = ingest.run(ingest.folder(spark, str(tmp_path / "in")), lambda df, n: seen.extend(df.select("name", "size", "sha256").collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [(r.name, r.size, r.sha256) for r in seen] == [("a.txt", 5, sha(b"hello"))]
    time.sleep(1)
    (tmp_path / "in" / "b.txt").write_text("more")
    ingest.run(ingest.folder(spark, str(tmp_path / "in")), lambda df, n: seen.extend(df.select("name", "size", "sha256").collect()), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.name for r in seen] == ["a.txt", "b.txt"]


def test_records_from_placed_text(spark):
    texts = [(700, 20.0, "Brake squeal after ACTI-"), (690, 20.0, "VE park"), (650, 10.0, "Topic number LI42.10‑P‑071234"), (640, 10.0, "Version 3"), (630, 10.0, "Function group 42"), (620, 10.0, "Date 03-17-2015"), (610, 10.0, "Validity Model 214, 213"), (600, 10.0, "and others"), (590, 10.0, "Cause unknown")]
    items = [("d", 1, t, 10.0, float(y), 100.0, h) for y, h, t in texts] + [("d", 1, "far", 400.0, 590.0, 20.0, 10.0)]
    df = spark.createDataFrame(items, "doc string, page int, str string, x double, y double, w double, h double")
    r = layout.records(layout.lines(df)).first()
    assert (r.li, r.ver, r.title, r.fgroup, r.date, r.pages) == ("LI42.10-P-071234", "3", "Brake squeal after ACTIVE park", "42", "03/17/2015", 1)
    assert r.validity == "Model 214, 213 and others" and r.text.endswith("Cause unknown far")
    screen = spark.createDataFrame([("1) A P110 3R CUSTOMER STATES NOISE 5401 1.0\nother",)], "t string")
    assert screen.select(layout.dispatch_lines(F.col("t")).alias("x")).first().x == ["CUSTOMER STATES NOISE"]


def test_diff(spark):
    pairs = spark.createDataFrame([("a\nb\nc", "a\nc\nd"), (None, "x"), ("1\n2\n3\nk\nl\nm\nn", "k\nl\nm\nn\n1\n2\n3")], "a string, b string")
    got = [[(r.op, r.a, r.b, r.n) for r in x.runs] for x in diff.diff(pairs).collect()]
    assert got[0] == [("=", 0, 0, 1), ("-", 1, 1, 1), ("=", 2, 1, 1), ("+", 3, 2, 1)]
    assert {op for op, *_ in got[2]} == {"<", "=", ">"}
    t = diff.totals(diff.diff(pairs)).collect()
    assert (t[0].removed, t[0].added, t[0].same) == (1, 1, 2) and t[2].moved == 3


@pytest.mark.parametrize("stretch", [100_000, 400])
def test_parts_by_size_over_stretches(spark, monkeypatch, stretch):
    """Next-fit from stretch to stretch; sizes of 0, of more than a part and null, large groups and small ones."""
    monkeypatch.setattr(facets, "STRETCH", stretch)
    rng = np.random.default_rng(9)
    rows = [(g, k, int(x)) for g in ("a", "b", None) for k, x in enumerate(rng.integers(0, 60, 6_000 if g == "a" else 50))]
    rows += [("zeros", k, 0 if k % 50 else int(x)) for k, x in enumerate(rng.choice([0, 1, 30, 100, 101, 500], 3000))]
    rows += [("ones", k, 1) for k in range(2000)] + [("null", k, None if k == 1300 else 70) for k in range(1500)] + [("blank", k, 0) for k in range(900)]
    want, now = [], {}
    for g, k, x in rows:
        part, held = now.get(g, (0, 0))
        if held is None or x is None:
            now[g] = part, None
        else:
            now[g] = (part + 1, x) if held > 0 and held + x > 100 else (part, held + x)
        want.append((g, k, x, now[g][0]))
    df = spark.createDataFrame(rows, "g string, k long, n long").repartition(5)
    packed = facets.parts_by_size(df, "g", "k", "n", 100)
    assert sorted(map(tuple, packed.collect()), key=str) == sorted(want, key=str)
    if stretch < 1000:
        laid = facets.laid(df, "g", "k")
        assert laid.groupBy("__stretch").count().agg(F.max("count")).first()[0] < 3 * stretch and laid.where("g = 'a'").select("__stretch").distinct().count() > 5


def test_offsets_and_ranks_of_any_type_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(facets, "STRETCH", 60)
    rng = np.random.default_rng(3)
    rows = [(g, f"{k:05d}" if k else None, int(x)) for g in ("a", None) for k, x in enumerate(rng.integers(0, 9, 700 if g else 40))]
    df = spark.createDataFrame(rows, "g string, pos string, n long").repartition(4)
    want, at, rank = set(), {}, {}
    for g, pos, n in rows:
        want.add((g, pos, n, at.get(g, 0)))
        at[g] = at.get(g, 0) + n
    assert {(r.g, r.pos, r.n, r.offset) for r in facets.running_offsets(df, "g", "pos", "n").collect()} == want
    got = {(r.g, r.pos): r.k for r in facets.ranked(df, F.col("g"), "pos", "k").collect()}
    for g, pos, _ in rows:
        rank[g] = rank.get(g, 0) + 1
        assert got[(g, pos)] == rank[g]


def test_rows_with_words(spark):
    items = [("d", 1, "  right ", 50.0, 700.6, 20.0, 9.0), ("d", 1, "left", 10.0, 701.0, None, 12.0), ("d", 1, " ", 5.0, 701.0, 1.0, 1.0), ("d", 1, "below", 10.0, 600.0, 30.0, None), ("d", 2, "next page", 1.0, 700.0, 5.0, -8.0)]
    got = layout.word_rows(spark.createDataFrame(items, "doc string, page int, str string, x double, y double, w double, h double")).orderBy("page", "y0").collect()
    assert [(r.text, r.x0, r.x1, r.y0, r.y1) for r in got] == [("left right", 10.0, 70.0, -701.0, -689.0), ("below", 10.0, 40.0, -600.0, -590.0), ("next page", 1.0, 6.0, -700.0, -692.0)]
    assert [tuple(w) for w in got[0].words] == [("left", 10.0, 10.0, 100.0), ("right", 50.0, 70.0, 100.0)]
    box = lambda *b: dict(zip(("x0", "y0", "x1", "y1"), b))
    data = {"lines": [{"text": " two  words ", "bbox": box(1, 2, 30, 12), "words": [{"text": "two", "confidence": 61, "bbox": box(1, 2, 9, 12)}, {"text": "words", "bbox": box(12, 2, 30, 12)}, {"text": " "}]}, {"text": ""}, {"text": "no box"}]}
    pages = spark.createDataFrame([("d", 1, json.dumps(data)), ("d", 2, "no json"), ("d", 3, None)], "doc string, page int, data string")
    got = layout.recognized_rows(pages).collect()
    assert [(r.page, r.text, r.x1, len(r.words)) for r in got] == [(1, "two words", 30.0, 2), (1, "no box", 0.0, 0)]
    assert [w.conf for w in got[0].words] == [61.0, 100.0]


def form(spark, *rows):
    """rows: (y0, [(text, x0, x1), ...])"""
    made = [("d", 1, " ".join(w[0] for w in words), float(words[0][1]), float(words[-1][2]), float(y), float(y + 10), [(t, float(a), float(b), 100.0) for t, a, b in words]) for y, words in rows]
    return spark.createDataFrame(made, f"doc string, page int, text string, x0 double, x1 double, y0 double, y1 double, words {layout.WORDS}")


def test_table_lines(spark):
    head = (100, [("Client", 5, 60), ("OP", 200, 220), ("CODE", 225, 260), ("INSTRUCTIONS", 400, 500), ("AND", 505, 530), ("DESCRIPTIONS", 535, 600)])
    rows = [
        (50, [("ABOVE", 300, 350), ("THE", 355, 380), ("TABLE", 385, 420)]),
        head,
        (120, [("small", 5, 30), ("print", 32, 60), ("A1", 205, 220), ("OIL", 270, 300), ("AND", 305, 330), ("FIL-", 335, 360)]),
        (134, [("more", 5, 30), ("TER", 270, 300), ("CHANGE", 305, 360)]),
        (160, [("B2", 205, 220), ("BRAKE", 270, 320)]),
        (162, [("CHECK", 330, 380)]),
        (163, [("no", 5, 20)]),
        (176, [("TOTAL", 270, 300), ("DUE", 310, 330)]),
        (190, [("AFTER", 270, 300)]),
    ]
    find = lambda *rows: [(r.pos, r.text, r.left) for r in layout.table_lines(form(spark, *rows), "(?i)INSTRUCTIONS? AND DESCRIPTIONS?", "(?i)INSTRUCTION", "^TOTAL").orderBy("pos").collect()]
    assert find(*rows) == [(0, "OIL AND FILTER CHANGE", ["A1"]), (1, "BRAKE CHECK", ["B2"]), (2, "AFTER", [])]
    assert find(*rows[:1], *rows[2:]) == []  # no heading
    bare = (100, [("INSTRUCTIONS", 400, 500), ("AND", 505, 530), ("DESCRIPTIONS", 535, 600)])
    assert find(bare, *rows[2:4])[0][1].startswith("small print A1 OIL")  # nothing left of it: rows count as a whole


def incoming(spark, *rows):
    return spark.createDataFrame([(i, n, t, len(c) if size is None else size, c) for i, n, t, c, size in rows], "id string, name string, type string, size long, content binary")


def test_intake_stores_links_and_follow_up_jobs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    got = intake.take_in(store, incoming(spark, ("n", "note.txt", "text/plain", b"hello", None), ("p", "pic.png", "image/png", b"PNG!", None), ("v", "clip.mp4", "video/mp4", b"mov", None), ("g", "ghost.txt", "text/plain", b"", 5)), "vault", 7, collection="RO 42", vin="wdd2130461a123456", order="r42")
    assert {(r.id, r.ok, r.error) for r in got.collect()} == {("n", True, None), ("p", True, None), ("v", True, None), ("g", False, "read: empty read")}
    note = store.get("files", ["n"]).first()
    assert (note.collection, note.vins, note.inFiles, note.kind) == ("RO 42", ["WDD2130461A123456"], 1, "text") and "wdd2130461a123456" in note.searchText
    assert sorted(r.toId for r in store.read("links").collect()) == ["n", "p", "v"]
    assert {(r.type, tuple(r.inputIds), r.state) for r in store.read("jobs").collect()} == {("thumb", ("p", "v"), "queued"), ("vin-detect", ("n", "p"), "queued")}
    assert bytes(store.get("blobs", ["n"]).first().blob) == b"hello" and store.generation() == 1
    intake.take_in(store, incoming(spark, ("d", "LI54.10-P-070001.pdf", "application/pdf", b"%PDF-1.4", None)), "li", 8)
    intake.take_in(store, incoming(spark, ("c", "a.csv", "text/csv", b"1,2", None)), "toolbox", 9, tab="csv")
    assert {(r.id, r.collection, r.kind, r.inFiles) for r in store.get("files", ["d", "c"]).collect()} == {("d", "LI Documents", "pdf", 0), ("c", "", "spreadsheet", 0)}
    later = {r.type: r for r in store.read("jobs").where("createdAt > 7").collect()}
    assert set(later) == {"li-import", "toolbox-intake"} and json.loads(later["toolbox-intake"].meta) == {"tab": "csv"}


def test_intake_of_known_bytes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    intake.take_in(store, incoming(spark, ("a", "a.txt", "text/plain", b"one", None), ("b", "b.txt", "text/plain", b"two", None)), "vault", 1)
    store.put("files", store.get("files", ["b"]).withColumn("deletedAt", F.lit(2).cast("long")))
    got = {r.id: r for r in intake.take_in(store, incoming(spark, ("c", "c.txt", "", b"two", None), ("d", "d.txt", "", b"three", None)), "vault", 3, decision="skip", order="r1").collect()}
    assert (got["c"].ok, got["c"].duplicateOf, got["c"].restored, got["c"].error) == (False, "b", True, "already stored") and got["d"].ok
    assert store.get("files", ["c"]).count() == 0 and store.get("files", ["b"]).first().deletedAt is None
    assert sorted(r.toId for r in store.read("links").collect()) == ["b", "d"]
    assert intake.take_in(store, incoming(spark, ("e", "e.txt", "", b"one", None)), "vault", 4, decision="reuse").first().ok
    assert store.get("files", ["e"]).first().blobId == "a" and store.get("blobs", ["e"]).count() == 0 and store.problems(store.parts(), store.generation()) == []


def test_targets_of_files(spark):
    names = [("LI54.10-P-070001.pdf", "application/pdf", "li"), ("quarterly.pdf", "application/pdf", "vault"), ("notes.txt", "text/plain", "vault"), ("a.TIDB", "", "inventory-import"), ("a.fvault", None, "vault-restore"), ("a.lidb", "", "li-restore"), ("a.fdb", "", "platform-restore"), (None, None, "vault"), ("about li54.10-p-070001 v2.pdf", "", "li")]
    df = spark.createDataFrame(names, "name string, type string, want string")
    assert df.where(intake.target_of(F.col("name"), F.col("type")) != F.col("want")).collect() == []


def test_the_search_for_numbers_goes_on_where_it_ended(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    files = [{"id": f"f{k}", "name": f"n{k}", "kind": "video" if k == 3 else "text", "vins": ["OLD"] if k == 5 else [], "vinScan": 9 if k == 4 else 0, "inFiles": 1, "deletedAt": 1 if k == 6 else None, "updatedAt": 50, "rev": 1} for k in range(40)]
    store.commit({"files": table(spark, "files", *files)}, verify=False)
    texts = spark.createDataFrame([(f"f{k}", None if k == 8 else f"VIN: W1NKM4GB9SF{k:06d} end" if k % 2 else "no number") for k in range(39)], "id string, text string")
    first = intake.scan_numbers(store, texts, 100, parts=4, most=2)
    assert first == 2 and 0 < store.read("files").where("vinScan = 100").count() < 35
    assert intake.scan_numbers(store, texts, 200, parts=4) <= 4 and intake.scan_numbers(store, texts, 300, parts=4) == 0
    got = {r.id: r for r in store.read("files").collect()}
    assert {i for i, r in got.items() if r.vinScan == 0} == {"f3", "f6", "f8", "f39"} and got["f4"].vinScan == 9
    assert got["f5"].vins == ["W1NKM4GB9SF000005", "OLD"] and got["f7"].vins == ["W1NKM4GB9SF000007"] and got["f10"].vins == []
    assert (got["f7"].updatedAt, got["f7"].rev) == (50, 2) and "w1nkm4gb9sf000007" in got["f7"].searchText
    intake.scan_numbers(store, texts, 400, force=True)
    assert store.get("files", ["f5"]).first().vins == ["W1NKM4GB9SF000005"] and store.get("files", ["f4"]).first().vinScan == 400
