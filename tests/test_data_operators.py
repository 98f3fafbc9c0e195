"""Snapshot changes, orphan references and hierarchies on small cases."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vaultlens.functions.ids import canonical_id, id_or_null
from vaultlens.operators import hierarchy as h
from vaultlens.operators.orphans import WEEK, orphan_references
from vaultlens.operators.snapshots import snapshot_changes, snapshot_intervals

HOW = {"group": "g", "seq": "s", "key": "k", "values": ["v", "w"], "version": "d"}
SCHEMA = "g string, s int, k string, v bigint, w int, d bigint, seq string, pos int, key int, r int"


def rows(spark, data):
    return spark.createDataFrame([(*x, "clash", 1, 2, 3) for x in data], SCHEMA)


def changes(spark, data, **how):
    return sorted((r["grp"], r["seq"], r["key"], r["change_kind"]) for r in snapshot_changes(rows(spark, data), **HOW | how).collect())


def test_id_spellings(spark):
    same = ["0A1b2c3d-0000-1111-2222-333344445555", "{0a1b2c3d-0000-1111-2222-333344445555}", "urn:uuid:0a1b2c3d-0000-1111-2222-333344445555", "0a1b2c3d000011112222333344445555"]
    got = spark.createDataFrame([(x,) for x in [*same, None]], "x string").select(canonical_id("x").alias("c")).collect()
    assert [r["c"] for r in got] == ["0a1b2c3d-0000-1111-2222-333344445555"] * 4 + [None]
    none = spark.createDataFrame([("0" * 32,), ("00000000-0000-0000-0000-000000000000",), (None,), ("",)], "x string").select(id_or_null("x").alias("c")).collect()
    assert all(r["c"] is None for r in none)


def test_changes_between_present_snapshots(spark):
    data = [("a", 1, "p", 1, 1, 0), ("a", 1, "q", 1, 1, 0), ("a", 3, "p", 2, 1, 0), ("a", 4, "p", 2, 1, 0), ("a", 4, "q", 1, 1, 0), ("b", 2, "z", 1, 1, 0)]
    assert changes(spark, data) == [("a", 3, "p", "changed"), ("a", 3, "q", "removed"), ("a", 4, "q", "added")]


def test_latest_version_counts_and_repeats_do_not(spark):
    data = [("a", 1, "p", 1, 1, 0)] * 3 + [("a", 2, "p", 9, 1, 0), ("a", 2, "p", 1, 1, 5), ("a", 2, "p", 7, 1, None)]
    assert changes(spark, data) == []


def test_nulls_equal_nulls_only_and_do_not_swap(spark):
    data = [("a", 1, "p", None, 5, 0), ("a", 2, "p", 5, None, 0), ("a", 1, "q", None, None, 0), ("a", 2, "q", None, None, 0)]
    assert changes(spark, data) == [("a", 2, "p", "changed")]


def test_rows_without_names(spark):
    data = [("a", 1, "p", 1, 1, 0), ("a", 2, None, 1, 1, 0), (None, 1, "p", 1, 1, 0), ("a", None, "p", 1, 1, 0)]
    assert changes(spark, data) == [("a", 2, "p", "removed")]
    assert changes(spark, []) == []


def test_changes_match_brute_force_on_both_join_ways(spark):
    dice = random.Random(5)
    data = [(g, s, f"k{k}", dice.choice([None, 1, 2]), 0, dice.randrange(9)) for g in "ab" for s in (1, 2, 5, 9) for k in range(12) if dice.random() < 0.7]
    want = []
    for g in "ab":
        seqs = sorted({x[1] for x in data if x[0] == g})
        for old, new in zip(seqs, seqs[1:]):
            before, after = ({x[2]: x[3] for x in data if x[:2] == (g, s)} for s in (old, new))
            want += [(g, new, k, "added") for k in after.keys() - before.keys()] + [(g, new, k, "removed") for k in before.keys() - after.keys()]
            want += [(g, new, k, "changed") for k in after.keys() & before.keys() if after[k] != before[k]]
    assert changes(spark, data) == sorted(want)
    assert changes(spark, data, broadcast_rows=1) == sorted(want)


def test_intervals(spark):
    data = [("a", s, "p", v, 1, 0) for s, v in ((1, 1), (2, 1), (3, 2), (5, 2))] + [("a", 4, "q", 1, 1, 0)]
    got = {(r["key"], r["first_seq"], r["next_seq"], r["last_pos"] - r["first_pos"]) for r in snapshot_intervals(rows(spark, data), **HOW).collect()}
    assert got == {("p", 1, 3, 1), ("p", 3, 4, 0), ("p", 5, None, 0), ("q", 4, 5, 0)}


def orphans(spark, refs, parents, **how):
    r = spark.createDataFrame([(*x, "extra") for x in refs], "ref_table string, ref_key string, target string, arrival bigint, k1 string")
    p = spark.createDataFrame([(*x, 7) for x in parents], "ref_table string, target string, arrival bigint, retired bigint, salt int")
    return sorted((x["ref_table"], x["ref_key"], x["reason"], x["period_week"]) for x in orphan_references(r, p, **how).collect())


def test_orphan_reasons(spark):
    refs = [("m", "1", "a", WEEK), ("m", "2", "b", 5), ("m", "3", "c", 5), ("m", "4", "d", 5), ("f", "5", "a", 5), ("m", "6", "gone", None), ("m", "7", None, 5), ("m", "8", "c", None)]
    parents = [("m", "a", 9 * WEEK, None), ("m", "a", 0, None), ("m", "b", 6, 1), ("m", "c", 1, 5), ("m", "d", 1, 6)]
    assert orphans(spark, refs, parents) == [("f", "5", "missing", 0), ("m", "2", "late", 0), ("m", "3", "deleted", 0), ("m", "6", "missing", None)]
    assert orphans(spark, [], parents) == []
    assert orphans(spark, refs[:1], []) == [("m", "1", "missing", 1)]


def test_hot_target_is_salted(spark):
    refs = [("m", str(i), "hot" if i % 3 else f"t{i}", 5) for i in range(600)]
    parents = [("m", "hot", 9, None)] + [("m", f"t{i}", 1, None) for i in range(0, 600, 6)]
    got = orphans(spark, refs, parents, hot_rows=50)
    assert len(got) == 400 + 100 and sum(x[2] == "late" for x in got) == 400
    assert got == orphans(spark, refs, parents)


def tree(spark, links, **how):
    df = spark.createDataFrame([(*x, "x") for x in links], "n string, p string, root string")
    return {r["node"]: r for r in h.hierarchy(df, node="n", parent="p", **how).collect()}


LINKS = [("a", None), ("b", "a"), ("c", "b"), ("c", "b"), ("d", "a"), ("e", "nowhere"), ("x", "y"), ("y", "z"), ("z", "x"), ("t", "x"), ("s", "s"), (None, "a")]


@pytest.mark.parametrize("size", [1_000_000, 1])
def test_hierarchy(spark, size):
    got = tree(spark, LINKS, component_rows=size)
    assert {k: (r["root"], r["depth"]) for k, r in got.items()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 1), "e": ("e", 0), **{k: (None, -1) for k in "xyzts"}}
    assert got["c"]["path"] == "a/b/c" and got["a"]["n_descendants"] == 3 and got["e"]["path"] == "e"
    assert got["s"]["back_edge_from"] == "s"
    assert [k for k in "xyz" if got[k]["back_edge_from"] is not None] == ["x"]
    assert [(got[k]["entry"], got[k]["n_descendants"]) for k in "abcd"] == [(0, 3), (1, 1), (2, 0), (3, 0)] and got["x"]["entry"] == -1


def test_deep_line_and_long_cycle(spark):
    line = [(f"n{i:04}", f"n{i - 1:04}" if i else None) for i in range(300)]
    ring = [(f"r{i:03}", f"r{(i + 1) % 37:03}") for i in range(37)]
    got = tree(spark, line + ring, with_path=False)
    assert all(got[f"n{i:04}"]["depth"] == i for i in range(300)) and all(got[k]["depth"] == -1 for k, _ in ring)
    labels = h.components(spark.createDataFrame(line + ring, "node string, parent string")).groupBy("label").agg(F.count("*").alias("c")).collect()
    assert sorted(r["c"] for r in labels) == [37, 300]


def test_small_and_large_components_give_the_same_rows(spark):
    dice = random.Random(8)
    links = [(f"t{i:03}", f"t{dice.randrange(i):03}" if i % 60 else None) for i in range(240)] + [(f"c{i:02}", f"c{(i * 7 + 3) % 20:02}") for i in range(20)] + [(f"d{i:02}", f"c{i % 20:02}") for i in range(30)]
    one, many = ({k: tuple(r) for k, r in tree(spark, links, component_rows=n).items()} for n in (1_000_000, 1))
    assert one == many and len(one) == 290


def test_long_chain(spark):
    n = 50_000
    df = spark.range(n).select(F.format_string("n%06d", "id").alias("n"), F.when(F.col("id") > 0, F.format_string("n%06d", F.col("id") - 1)).alias("p"))
    for size in (1_000_000, 1):
        got = h.hierarchy(df, node="n", parent="p", with_path=False, component_rows=size)
        assert got.where((F.col("depth") == F.substring("node", 2, 6).cast("int")) & (F.col("root") == "n000000") & (F.col("entry") == F.col("depth")) & (F.col("n_descendants") == n - 1 - F.col("depth"))).count() == n


def test_paths_leave_the_task_in_blocks(monkeypatch):
    monkeypatch.setattr(h, "PATH_BLOCK", 1000)
    rows = pd.DataFrame({"node": [f"n{i:03}" for i in range(200)], "parent": [None] + [f"n{i:03}" for i in range(199)], "label": ["n000"] * 200})
    out = list(h._walk(iter([rows]), "/", True))
    assert len(out) > 50 and max(x["path"].str.len().sum() for x in out) < 3000
    every = pd.concat(out).set_index("node")
    assert every.loc["n003", "path"] == "n000/n001/n002/n003" and every.loc["n199", "depth"] == 199


def test_hierarchy_of_nothing(spark):
    assert tree(spark, []) == {}
