"""Every registered query of the core against DuckDB, at the small scale."""

import re

import pytest

from dossier.operators import diff
from dossier.plans import catalogue, functions, stored, views, writes  # noqa: F401 (each adds queries)
from tests.helpers import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, SF), duck(SF, catalogue.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_vin_scan_reads_whole_texts(spark, tmp_path):
    texts = {1: "x " * 40 + "VIN: WDB1240301A123456, end", 2: "WDB 1240301A12345 6" + " word" * 3000 + " Datenkarte W1K2140471A068698.", 3: "none", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: sorted(f"{r.vins},{r.fins}".strip(",").split(",")) for r in catalogue.QUERIES["vin_scan"](spark, str(tmp_path)).collect()}
    number = re.compile(r"(?<![A-Z0-9])W(?:DB|1K|1N)(?:[ ]?[A-Z0-9]){14}(?![A-Z0-9])")
    for k, text in texts.items():
        said = f"{text or ''} W1N KM4GB9SF{k:06d} end"
        assert got[k] == sorted(m.replace(" ", "") for m in number.findall(said))
    assert [len(got[k]) for k in (1, 2, 3, 4)] == [2, 3, 1, 1]


def test_document_diff_takes_near_copies_of_whole_texts(spark, tmp_path):
    base = [[f"line {n} of text {t} says {n * 7 + t} things" for n in range(40)] for t in range(4)]
    texts = {}
    for t, lines in enumerate(base):
        texts[10 * t] = lines
        texts[10 * t + 1] = [f"another opening {t}", *lines[1:]]
        texts[10 * t + 2] = [*lines[:20], "put between", *lines[20:]]
        texts[10 * t + 3] = ["one boilerplate opening line"] + [f"unlike {t} {n * n} {n}" for n in range(30)]
    rows = [(k, "\n".join(x), f"s{k % 3}") for k, x in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = {k: {tuple(w[i : i + 5]) for w in [text.split()] for i in range(len(w) - 4)} for k, text, _ in rows}
    first = {k: k for k in texts}
    for _ in texts:  # the smallest id that chains of near copies reach
        first = {k: min(first[j] for j in texts if len(grams[k] & grams[j]) >= 0.8 * len(grams[k] | grams[j])) for k in texts}
    want = set()
    for k, f in first.items():
        ops = [op for op, *_ in diff.steps(texts[f], texts[k])]
        want |= {(k, ops.count("-"), ops.count("+"), 0, ops.count("="))} if f != k else set()
    got = {tuple(r) for r in catalogue.QUERIES["document_diff"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 8


def test_alike_sets_against_all_pairs(spark):
    import random

    from dossier.operators import relations

    rng = random.Random(4)
    base = [[f"line {g} {k}" for k in range(12)] for g in range(6)]
    rows = [(k, [x for x in base[k % 6] if rng.random() > 0.12] + [f"own {k}"] * (k % 3) + ["common", ""]) for k in range(90)]
    rows += [(200 + k, list(rows[k][1])) for k in range(5)] + [(300, []), (301, [" "]), (302, ["common"]), (303, ["common", "common"])]
    sets = {k: frozenset(x for x in v if x.strip()) for k, v in rows}
    first = {}
    for k in sorted(sets):  # of equal sets the smallest id stands for all
        first.setdefault(sets[k], k)
    want = {}
    for b in sets:
        near = [a for a in first.values() if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want |= {b: min(near)} if near else {}
    pairs = relations.alike(spark.createDataFrame(rows, "id long, items array<string>"), "id", "items", 80).collect()
    got = {}
    for r in pairs:
        assert r.a < r.b and 100 * len(sets[r.a] & sets[r.b]) >= 80 * len(sets[r.a] | sets[r.b])
        got[r.b] = min(r.a, got.get(r.b, r.a))
    assert got == want and len(want) > 40


def test_ranks_of_one_key_over_stretches(spark, monkeypatch):
    from dossier.operators import facets

    monkeypatch.setattr(facets, "STRETCH", 7)
    rows = [(k, "a" if k % 3 else None) for k in range(100)] + [(None, "a")]
    df = spark.createDataFrame(rows, "id long, name string")
    for key in ("a", None):
        got = [r.n for r in sorted((r for r in facets.ranked(df, df["name"], "id", "n").collect() if r.name == key), key=lambda r: (r.id is not None, r.id))]
        assert got == list(range(1, len(got) + 1))


def test_customer_360_keeps_the_latest_orders_early(spark, capsys):
    catalogue.QUERIES["customer_360"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan and "Partial" in plan
