"""Queries look at their whole tables."""

from pyspark.sql import functions as F

from vaultlens.operators.hierarchy import hierarchy
from vaultlens.plans import bind
from vaultlens.plans import file_queries as fq
from vaultlens.plans import range_queries as rq


def chunk_plans(spark, folder, rows):
    """A chunk_plan table of (chain, seq, offset, length)."""
    cells = [(i, f"{c:032x}", s, 0, i, o, n, 1) for i, (c, s, o, n) in enumerate(rows)]
    spark.createDataFrame(cells, "plan_id bigint, chain_id string, seq int, region smallint, chunk_index bigint, plan_offset bigint, plan_len int, received_unix bigint").write.parquet(f"{folder}/chunk_plan.parquet")
    return str(folder)


def test_reads_beyond_4_gib_are_aligned(spark, tmp_path):
    far, unit = 2**54, 4 * bind.CHUNK
    d = chunk_plans(spark, tmp_path, [(1, 0, 5, 10), (1, 0, far + 7, 100), (1, 1, 3 * unit, unit), (2, 0, 2**32, 50)])
    got = sorted((r["chain_id"][-1], r["seq"], r["start"], r["end_incl"]) for r in rq.chunk_align(spark, d).collect())
    # the last read of a chain's region ends the device, in every snapshot
    assert got == [("1", 0, 0, unit - 1), ("1", 0, far, far + 106), ("1", 1, 3 * unit, 4 * unit - 1), ("2", 0, 2**32, 2**32 + 49)]
    assert rq.chunk_plan_rows(spark, d).agg(F.sum("plan_len")).first()[0] == 2 * unit + 107 + 50
    assert [tuple(r) for r in rq.disk_gaps(spark, d).where("seq = 1 and chain_id like '%1'").select("gap_start", "gap_end").collect()] == [(4 * unit, far + 106)]


def test_quiet_windows_span_the_whole_table(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", 0, "click", 1.0), (2, "2024-01-12 03:10:00", 1, "click", 1.0)], "event_id bigint, ts string, user_id bigint, event_type string, value double")
    events.withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = rq.quiet_windows(spark, str(tmp_path)).collect()
    assert len(got) == 2 * (11 * 48 + 7) and sum(r["n_writes"] for r in got) == 2
    assert sorted((r["dev"], f"{r['t0']:%d %H:%M}") for r in got if not r["is_quiet"]) == [("0", "01 00:00"), ("1", "12 03:00")]


def test_a_file_with_other_xattrs_is_changed(spark, tmp_path):
    cells = "entry_id bigint, seq int, path string, xattrs array<struct<name:binary,val:binary>>"
    a, b, c = (b"a", b"1"), (b"b", b"2"), (b"b", b"3")
    rows = [(i, s, p, x) for i, (s, p, x) in enumerate([(0, "same", [a, b]), (1, "same", [b, a]), (0, "other", [a, b]), (1, "other", [a, c]), (0, "none", None), (1, "none", None), (0, "gone", [a]), (1, "gone", None)])]
    df = spark.createDataFrame(rows, cells).withColumn("path", F.col("path").cast("binary")).withColumn("chain_id", F.lit(f"{1:032x}")).withColumn("delivered_unix", F.lit(1).cast("bigint"))
    for name, kind in [("parent_path", "binary"), ("file_kind", "tinyint"), ("mode", "int"), ("uid", "bigint"), ("gid", "bigint"), ("mtime_sec", "bigint"), ("mtime_nsec", "int"), ("size", "bigint"), ("rdev", "bigint"), ("hardlink_group", "bigint"), ("link_target", "binary")]:
        df = df.withColumn(name, F.lit(None).cast(kind))
    df.write.parquet(f"{tmp_path}/file_entries.parquet")
    got = {r["path"]: r["status"] for r in fq.file_incremental(spark, str(tmp_path)).collect()}
    assert got == {"same": "unchanged", "other": "changed", "none": "unchanged", "gone": "changed"}
    assert {r["status"]: r["n_files"] for r in fq.file_differential(spark, str(tmp_path)).collect()} == {"unchanged": 2, "changed": 2}


def test_cycles_do_not_depend_on_the_size_of_their_component(spark):
    links = spark.createDataFrame([("d", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("e", "a"), ("s", "s"), ("r", None), ("t", "r")], "node string, parent string")
    small, large = (sorted(map(tuple, hierarchy(links, node="node", parent="parent", component_rows=n).where("back_edge_from is not null").select("node", "back_edge_from").collect())) for n in (1000, 1))
    assert small == [("b", "c"), ("s", "s")]
    assert large == small
