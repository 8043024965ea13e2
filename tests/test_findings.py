"""What a review found on odd inputs and larger tables; each test failed before."""

from pyspark.sql import functions as F

from dossier.operators import layout
from dossier.plans import catalogue, functions, stored, views, writes  # noqa: F401 (each adds queries)
from tests.helpers import same_rows


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def agrees(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for at in folder.glob("*.parquet"):
        con.execute(f"create view {at.stem} as select * from '{at}/*.parquet'")
    got = con.execute(catalogue.ORACLES[name])
    same_rows(catalogue.QUERIES[name](spark, str(folder)), ([c[0] for c in got.description], got.fetchall()))


def test_letters_that_become_two_part_numbers(spark, tmp_path):
    texts = ["abc \u00df\u00df\u00df dgh jk", "\u00dfbcdefghjkab", "bbbbbbbbbbbb\u00df", "\ufb00bbbbbbbbbbbb", "\u0131abcdefghjklmn", "\u017fbcdefghjklmn b"]
    saved(spark, tmp_path, "documents", list(enumerate(t for t in texts for _ in range(3))), "doc_id long, text string")
    agrees(spark, tmp_path, "vin_scan")


def test_values_at_the_bounds_of_units(spark, tmp_path):
    back = pow(7919, -1, 1000003)  # keys whose value is a power of ten or next to one, with every exponent
    keys = [((m - 1) * back) % 1000003 + j * 1000003 for m in (1, 10, 100, 1000, 10**4, 10**5, 10**6, 10**6 + 1, 999_999) for j in range(17)]
    saved(spark, tmp_path, "orders", [(k,) for k in keys], "o_orderkey long")
    agrees(spark, tmp_path, "value_formats")


def test_pairs_of_shared_keys_without_a_shuffle_of_pairs(spark, monkeypatch):
    from dossier.operators import relations

    monkeypatch.setattr(relations, "BLOCK", 3)
    monkeypatch.setattr(relations, "PAIRS", 5)
    left = [(k % 30, "abc"[k % 3]) for k in range(40)] + [(1, "x"), (1, "x"), (2, None), (None, "a")]
    right = [(100 + k % 17, "abd"[k % 3]) for k in range(40)] + [(100, "x"), (100, None)]
    sides = [spark.createDataFrame(rows, f"{name} int, key string") for rows, name in ((left, "a"), (right, "b"))]
    every = [(a, b) for a, x in left for b, y in right if x is not None and x == y]
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    for once, want in ((True, set(every)), (False, every)):
        pairs = relations.met(*sides, once=once)
        assert order(pairs.collect()) == order(want)
    plan = relations.met(*sides)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.index("Join") < plan.index("Repartition")  # no shuffle above the join


def test_joins_over_few_keys_make_their_pairs_last(spark):
    from dossier.plans import views

    for name in ("document_tools", "tool_documents", "vehicle_tools", "vehicle_documents", "tagged_documents"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "RepartitionByExpression" in plan, name


def test_documents_of_vehicles_are_counted_by_sets_of_series(spark):
    from dossier.operators import relations

    cars = [(k % 20, str(200 + k * k % 7)) for k in range(40)] + [(50, ""), (51, "999"), (None, "200")]
    docs = [(k, f"Model series {200 + k % 7}, {200 + k % 3}") for k in range(30)] + [(3, "Model series 204")]
    v, d = spark.createDataFrame(cars, "vin int, series string"), spark.createDataFrame(docs, "id int, validity string")
    want = relations.vehicle_documents(v, d).groupBy("vin").count()
    found = relations.vehicle_document_counts(v, d)
    assert sorted(map(str, found.toDF("vin", "count").collect())) == sorted(map(str, want.collect()))
    pairs = {(c, i) for c, x in cars for i, said in docs if x and x in said}
    assert len(pairs) == relations.vehicle_documents(v, d).count()


def test_store_gets_any_number_of_keys(spark, tmp_path):
    from dossier.sources.store import Store

    store = Store(spark, str(tmp_path / "store"))
    rows = spark.range(9000).select(F.concat(F.lit("t"), "id").alias("id"), F.lit("x").alias("desc"))
    store.commit({"tools": rows}, verify=False)
    store.remove("tools", rows.where("id = 't5'").select("id"), verify=False)
    wanted = [f"t{k}" for k in range(5, 9003, 2)]
    have = sorted(f"t{k}" for k in range(7, 9000, 2))
    keys = spark.createDataFrame([(k,) for k in wanted], "id string")
    for asked in (wanted, keys, keys.union(keys)):
        assert sorted(r.id for r in store.get("tools", asked).collect()) == have
    assert sorted(r.id for r in store.get("tools", [*wanted[:900], None]).collect()) == sorted(f"t{k}" for k in range(7, 1805, 2))


def test_stretches_of_wide_rows_are_shorter(spark, monkeypatch):
    from dossier.operators import facets

    monkeypatch.setattr(facets, "WIDTH", 1000)
    rows = spark.range(60).select("id", F.lit("a").alias("name"), F.repeat(F.lit("x"), 100).alias("text"))
    laid = facets.laid(rows, "name", "id")
    assert laid.select("__stretch").distinct().count() > 3
    assert [r.n for r in facets.ranked(rows, F.col("name"), "id", "n").orderBy("id").collect()] == list(range(1, 61))


def test_ranks_of_documents_carry_no_texts(spark, monkeypatch):
    from dossier.operators import facets

    seen, laid = [], facets.laid
    monkeypatch.setattr(facets, "laid", lambda df, *by: seen.append(df.columns) or laid(df, *by))
    for name in ("unique_names", "payload_offsets"):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and not any("text" in columns for columns in seen)


def test_container_headers_are_not_held(spark, tmp_path, monkeypatch):
    """Headers are cut anywhere, numbers and letters of several bytes too; what goes through the driver does not grow."""
    import json
    import pickle

    from dossier.sources import bytes as byte_ranges
    from dossier.sources import containers

    tools = [{"id": f"t{k}", "desc": "ü\U0001f527" * (k % 5), "n": [k, {"x": -1.5e3 * k}]} for k in range(5000)]
    meta = {"photos": [{"id": "p", "len": 3}], "other": 12345678, "tools": tools, "format": "catalogue"}
    for ascii_, indent in ((True, None), (False, 1)):
        head = json.dumps(meta, ensure_ascii=ascii_, indent=indent).encode()
        data = b"TIDB" + (1).to_bytes(4, "little") + len(head).to_bytes(4, "little") + head + b"pic"
        (tmp_path / "c.tidb").write_bytes(data)
        for block in (1 << 20, 61):
            monkeypatch.setattr(byte_ranges, "BLOCK", block)
            monkeypatch.setattr(byte_ranges, "ROWS_OF_RANGE", 700)
            reader = byte_ranges._Reader(str(tmp_path / "c.tidb"), None, byte_ranges.RANGE)
            ranges = reader.partitions()
            assert len(ranges) == 9 and len(pickle.dumps(ranges)) < 3000
            got = [tuple(r[c] for c in ("part", "pos", "id", "meta", "content")) for p in ranges for b in reader.read(p) for r in b.to_pylist()]
            assert sorted(got, key=str) == sorted(map(tuple, containers.parse(data, "tidb")), key=str)
    rows = spark.range(3000).select(F.lit("tool").alias("part"), F.col("id").alias("pos"), F.concat(F.lit("t"), "id").alias("id"), F.to_json(F.struct("id")).alias("meta"), F.lit(None).cast("binary").alias("content"))
    writer = byte_ranges._Writer(str(tmp_path / "w.tidb"), "tidb", {}, True)
    sent = [writer.write(iter(part)) for part in (rows.collect()[:1500], rows.collect()[1500:])]
    assert len(pickle.dumps(sent)) < 1000
    writer.commit(sent[::-1])
    assert [(r[0], r[2]) for r in containers.parse((tmp_path / "w.tidb").read_bytes(), "tidb")] == [("tool", k) for k in range(3000)]


def test_pages_of_a_form_are_dealt_once(spark, tmp_path):
    """What is the same for all rows of a page is worked out once for the page, and its items are shuffled once."""
    rows = [(d, n, d * 7 + n, d * 3 + n) for d in range(40) for n in range(1, 9) if (d + n) % 4]
    saved(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long")
    agrees(spark, tmp_path, "form_table_lines")
    items = spark.createDataFrame([("d", 1, "HEAD", 10.0, 90.0, 9.0, 9.0), ("d", 1, "  \t", 0.0, 80.0, 9.0, 9.0), ("d", 1, "text", 20.0, 60.0, 9.0, 9.0)], "doc string, page int, str string, x double, y double, w double, h double")
    found = layout.table_lines(layout.word_rows(items), "HEAD", "HEAD")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [r.text for r in found.collect()] == ["text"]
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_jobs_queued_a_microsecond_apart_are_claimed_in_order(spark, tmp_path):
    events = [("view", 9, "2024-01-01 00:00:00.000100"), ("view", 10, "2024-01-01 00:00:00.000200"), ("click", 11, "2024-01-01 00:00:00"), ("click", 12, "2024-01-01 00:00:00")]
    told = spark.createDataFrame(events, "event_type string, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    told.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    agrees(spark, tmp_path, "live_claims")


def test_events_of_a_large_batch_are_not_held_in_memory():
    import random
    import tracemalloc

    from dossier.streaming import live

    rnd = random.Random(5)
    rows = lambda: ((rnd.randrange(50_000), f"job {k % 97}", "enqueue", f"job {k}", None, None, False) for k in range(200_000))
    tracemalloc.start()
    n, last = 0, ()
    for r in live.in_order(rows(), 2_000):
        assert r[:3] >= last
        n, last = n + 1, r[:3]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and peak < 12_000_000  # all of them take over 50,000,000 bytes


def test_queued_jobs_lie_in_pages_of_state():
    import random

    from dossier.streaming import live

    class Kept(dict):
        getValue, updateValue, removeKey = dict.get, dict.__setitem__, lambda self, k: self.pop(k, None)
        iterator = dict.items

    rnd, pages, begins, all_ = random.Random(7), Kept(), Kept(), set()
    for batch in range(60):
        waiting = live.Waiting(pages, begins, 4)  # as a new task finds it
        for _ in range(60):
            job = (rnd.randrange(300), f"j{rnd.randrange(1000)}", rnd.randrange(5))
            if rnd.random() < (0.75 if batch < 40 else 0.2):
                if not any(job[:2] == j[:2] for j in all_):
                    waiting.add(*job)
                    all_.add(job)
            elif all_ and rnd.random() < 0.5:
                gone = rnd.choice(sorted(all_))
                waiting.remove(*gone[:2])
                all_.remove(gone)
            else:
                found = waiting.oldest()
                assert found == (min(all_) if all_ else None)
                all_.discard(found)
            assert sum(map(len, waiting.loaded.values())) <= 84
        waiting.close()
        assert sorted(j for since, ids, n in pages.values() for j in zip(since, ids, n)) == sorted(all_)


def test_a_row_finds_the_ids_of_a_block_as_one_list(spark, monkeypatch):
    """The join makes a row for each block, not for each pair, and ids of several keys are paired once."""
    import random

    from dossier.operators import relations

    monkeypatch.setattr(relations, "BLOCK", 4)
    tables, write = {}, relations.written
    monkeypatch.setattr(relations, "written", lambda df, name: tables.setdefault(name, []).append(write(df, name)) or tables[name][-1])
    rnd = random.Random(3)
    left, right = ([(rnd.randrange(25), rnd.choice("abcdefg")) for _ in range(60)] for _ in "lr")
    right += [(7, "a")] * 90
    sides = [spark.createDataFrame(rows, f"{name} int, key string") for rows, name in ((left, "a"), (right, "b"))]
    every = [(a, b) for a, x in left for b, y in right if x == y]
    for once, want in ((True, set(every)), (False, every)):
        pairs = relations.met(*sides, once=once)
        assert sorted(map(tuple, pairs.collect())) == sorted(want)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate posexplode") < plan.index("Join")
        blocks = tables["blocks"][-1].select(F.size("ids").alias("n")).collect()
        assert max(r.n for r in blocks) < 30 and sum(r.n for r in blocks) >= len(set(right) if once else right) - 60


def test_new_jobs_are_not_asked_for_and_changes_are_written_together(monkeypatch):
    import random

    from dossier.streaming import live

    class Kept(dict):
        calls = 0

        def _call(self, found):
            self.calls += 1
            return found

        exists = lambda self: bool(self)
        containsKey = lambda self, k: self._call(k in self)
        getValue = lambda self, k: self._call(self.get(k))
        updateValue = lambda self, k, v: self._call(self.__setitem__(k, v))
        removeKey = lambda self, k: self._call(self.pop(k, None))

    rnd, state, all_ = random.Random(11), Kept(), {}
    for batch, bits in enumerate((1 << 16, 1 << 16, 8)):  # with a filter of eight bits every name seems to be known
        monkeypatch.setattr(live.Jobs, "BITS", bits)
        if batch == 2:
            state.clear(), all_.clear()
        jobs = live.Jobs(state, 10)  # as a new task finds it
        for _ in range(800):
            id_ = f"j{rnd.randrange(120)}"
            assert jobs.get(id_) == all_.get(id_)
            if rnd.random() < 0.8:
                all_[id_] = ["queued", rnd.randrange(9), None, 0, None, None]
                jobs.put(id_, list(all_[id_]))
            elif id_ in all_:
                del all_[id_]
                jobs.remove(id_)
            assert len(jobs.last) <= 10
        jobs.close()
        assert {k: list(v) for (k,), v in state.items()} == all_
    monkeypatch.setattr(live.Jobs, "BITS", 1 << 20)
    state = Kept()
    jobs = live.Jobs(state, 1000)
    for k in range(500):
        assert jobs.get(f"j{k}") is None
        jobs.put(f"j{k}", ["queued", k, None, 0, None, None])
        jobs.put(f"j{k}", ["running", k, k, 1, "w", None])
    jobs.close()
    assert state.calls == len(state) == 500  # one call for each job, where there were three


def test_jobs_of_a_type_that_exceed_what_a_task_holds(spark, tmp_path):
    """With so few jobs in memory that they are written and read again, changes are those of all jobs in memory."""
    from dossier.streaming import ingest, live

    at = "2024-01-01 00:00:"
    events = [("t", f"j{k}", f"{at}{k:02}", "enqueue", None, None, None) for k in range(40)]
    events += [("t", "j3", f"{at}41", "enqueue", None, None, None), ("t", "j4", f"{at}42", "cancel", None, None, None)]
    events += [("t", None, f"{at}{43 + k % 2}.{k:03}", "claim", f"w{k}", None, None) for k in range(6)]
    events += [("t", "j0", f"{at}50", "done", "w0", None, None), ("t", "j1", f"{at}51", "fail", "w2", None, None), ("t", "j9", f"{at}52", "done", "w0", None, None)]
    rows = spark.createDataFrame(events, live.EVENT.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    told = []
    try:
        for held in (4, 50_000):
            changes = live.live_jobs(spark.readStream.schema(live.EVENT).parquet(str(tmp_path / "events")), held=held)
            found = []
            ingest.run(changes, lambda b, n: found.extend(map(tuple, b.collect())), str(tmp_path / f"state{held}")).awaitTermination()
            told.append(sorted(found, key=str))
    finally:
        spark.conf.set(provider, before)
    assert told[0] == told[1] and sum(r[3] == "running" for r in told[0]) == 6 and len(told[0]) >= 49


def test_rows_without_a_place_stand_on_the_last_island(spark, tmp_path):
    rows = [(o, n, None if n == 2 else n, None if n == 5 else n * o) for o in range(1, 9) for n in (1, 2, 3, 5, 9)]
    saved(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    agrees(spark, tmp_path, "row_islands")
