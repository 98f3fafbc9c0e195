"""Parsers of tool output, publishing, and streams, on retyped text."""

import pytest
from pyspark.sql import functions as F

from vaultlens.sources import parsers, sinks
from vaultlens.streaming.jobs import stall_stream
from vaultlens.streaming.tracking import DirtyMap, trace_stream


def lines(spark, text):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "file string, line_no int, line string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ext4(spark, tmp_path):
    text = "Block count:              100\nFree blocks:              9\nFirst block:              0\nBlock size:               4096\n\nGroup 0: (Blocks 0-49) csum\n  Free blocks: 3-5, 7\nGroup 1: (Blocks 50-99)\n  Free blocks: 60-64\nGroup 2: (Blocks 100-101)\n  Free blocks: "
    (tmp_path / "x.txt").write_text(text)
    got = parsers.text_lines(spark, str(tmp_path))
    assert tuple(parsers.ext4_facts(got).drop("file").first()) == (4096, 100, 0, 9)
    assert rows(parsers.ext4_free(got).drop("file")) == [(0, 3, 5), (0, 7, 7), (1, 60, 64)]


def test_xfs(spark):
    assert rows(parsers.key_values(lines(spark, "blocksize = 4096\nagcount = 4\nagcount = 5\nnoise")).drop("file")) == [("agcount", "5"), ("blocksize", "4096")]
    assert rows(parsers.xfs_free(lines(spark, "agno agbno len\n0 12 5\n  1   7  9\n1 1 2 3 4\ntotal free extents 2")).drop("file")) == [(0, 12, 5), (1, 7, 9)]


def test_mounts_and_identities(spark):
    text = "22 1 8:1 / /mnt/a\\040b rw shared:1 - ext4 /dev/sda1 rw\n23 1 0:5 /@ /x rw - btrfs /dev/sdb rw\nshort - x"
    assert rows(parsers.mountinfo(lines(spark, text)).drop("file")) == [(22, "8:1", "/", "/mnt/a b", "ext4", "/dev/sda1"), (23, "0:5", "/@", "/x", "btrfs", "/dev/sdb")]
    got = parsers.blkid(lines(spark, "DEVNAME=/dev/a\nUUID=1=2\n\nUUID=3\n\nDEVNAME=/dev/b")).collect()
    assert sorted((r["facts"]["DEVNAME"], r["facts"].get("UUID")) for r in got) == [("/dev/a", "1=2"), ("/dev/b", None)]
    assert rows(parsers.subvolumes(lines(spark, "ID 256 gen 9 top level 5 path a b/c\nx")).drop("file")) == [("256", "5", "a b/c")]


def test_findmnt(spark):
    doc = '{"filesystems":[{"target":"/","source":"a","children":[{"target":"/b","source":"c","children":[{"target":"/b/d"}]}]}]}'
    got = parsers.findmnt(spark.createDataFrame([("f", doc)], "file string, json string"), 3)
    assert rows(got.select("level", "target")) == [(0, "/"), (1, "/b"), (2, "/b/d")]


TRACE = """dd-9 [003] ..... 7.1: block_bio_queue: 8,1 WS 100 + 8 [dd]
dd-9 [003] ..... 7.1: block_bio_queue: 8,1 R 300 + 8 [dd]
k-1 [000] ..... 7.2: block_rq_complete: 8,1 WS () 108 + 8 none,0,0 [0]
k-1 [000] ..... 7.3: block_rq_complete: 8,1 FF () 18446744073709551615 + 0 none,0,0 [0]
other: line
x: copy-barrier-4"""


def test_trace(spark):
    got = parsers.trace(lines(spark, TRACE)).orderBy("line_no").select("phase", "major", "minor", "flags", "sector", "sectors", "malformed")
    assert [tuple(r) for r in got.collect()] == [("queue", 8, 1, "WS", 100, 8, False), ("queue", 8, 1, "R", 300, 8, False), ("complete", 8, 1, "WS", 108, 8, False), ("complete", 8, 1, "FF", 0, 0, False)]
    assert parsers.trace(lines(spark, "a: block_bio_queue: 8,1 W x + 8")).first()["malformed"]
    assert parsers.loss_stats(lines(spark, "overrun: 3\n dropped events: 2\nentries: 9")).first()["n_lost"] == 5


def test_live_dirty_map(spark, tmp_path):
    regions = spark.createDataFrame([("8:1", None, 1, 0, 999)], "dev string, part_dev string, region int, lo bigint, hi bigint")
    held = DirtyMap(regions, 10)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text(TRACE)
    run = lambda: held.start(trace_stream(spark, str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
    run()
    assert held.marker == 4 and rows(held.take()) == [(1, 10), (1, 11)] and held.take() is None
    (tmp_path / "in" / "2.txt").write_text("a: block_bio_queue: 8,1 W 500 + 1 [x]")
    run()
    assert rows(held.take()) == [(1, 50)]
    (tmp_path / "in" / "3.txt").write_text("a: block_bio_queue: 8,1 broken")
    run()
    with pytest.raises(ValueError):
        held.take()


def test_stalls(spark, tmp_path):
    events = [("j", f"2025-01-01 00:0{i}:00", i, p, 0) for i, p in enumerate("aabbc")]
    spark.createDataFrame(events, "job_id string, ts string, event_no bigint, phase string, done bigint").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, ts timestamp, event_no bigint, phase string, done bigint").parquet(str(tmp_path / "in"))
    stall_stream(stream, 100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["kind"], r["phase"], r["idle_seconds"]) for r in got) == [("advance", "a", 0.0), ("advance", "b", 0.0), ("advance", "c", 0.0), ("stalled", "a", 120.0), ("stalled", "b", 120.0)]


def test_publishing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a, b = (spark.createDataFrame([(i, "x")], "k int, v string") for i in (1, 2))
    assert sinks.publish_once(a, path) and not sinks.publish_once(b, path)
    assert spark.read.parquet(path).first()["k"] == 1
    sinks.replace(b, path)
    assert spark.read.parquet(path).first()["k"] == 2
    assert not [p for p in tmp_path.iterdir() if p.name != "t"]
    ledger = f"file://{tmp_path}/ledger"
    both = a.unionByName(b).unionByName(b)
    assert sinks.append_new(both, ledger, ["k"]) == 2 and sinks.append_new(both, ledger, ["k"]) == 0
    assert spark.read.parquet(ledger).count() == 2
    assert sinks.as_report(a, "m").first()["report"] == '{"mode":"m","k":1,"v":"x"}'


def test_ledger_fails_as_a_whole(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"id": 1}')
    assert parsers.ledger(spark, str(tmp_path), "id int").count() == 1
    (tmp_path / "2.json").write_text('{"id": ')
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        parsers.ledger(spark, str(tmp_path), "id int").collect()
    cached = spark.createDataFrame([('{"a": 1}',), ("broken",), (None,)], "j string")
    assert [r["parsed"]["a"] if r["parsed"] else None for r in parsers.cached_json(cached, "j", "a int").collect()] == [1, None, None]


def test_file_tree(spark, tmp_path):
    from vaultlens.sources.filetree import FileTree

    for p in ("a/b", "skip", "z"):
        (tmp_path / p).mkdir(parents=True)
    (tmp_path / "a/b/f").write_bytes(b"12345")
    (tmp_path / "skip/g").write_bytes(b"1")
    (tmp_path / "link").symlink_to("a/b/f")
    spark.dataSource.register(FileTree)
    df = spark.read.format("filetree").option("excludes", f"{tmp_path}/skip:").load(str(tmp_path))
    got = {bytes(r["path"]).decode(): (r["file_kind"], r["size"], bytes(r["parent_path"]).decode()) for r in df.collect()}
    assert got == {"": (2, 0, ""), "a": (2, 0, ""), "a/b": (2, 0, "a"), "a/b/f": (1, 5, "a/b"), "link": (3, 0, ""), "z": (2, 0, "")}
    assert bytes(df.where("file_kind = 3").first()["link_target"]) == b"a/b/f"
