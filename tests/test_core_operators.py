"""Small fixed cases of the core operators."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultlens.functions import text as tx
from vaultlens.operators import chains as ch
from vaultlens.operators import chunking as ck
from vaultlens.operators import devices as dv
from vaultlens.operators import files as fl
from vaultlens.operators import jobs as jb
from vaultlens.operators import ranges as rg
from vaultlens.operators import retention as rt
from vaultlens.operators import tracking as tr


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def ranges(spark, *pairs):
    return spark.createDataFrame([("d", *p) for p in pairs], "g string, start bigint, end_incl bigint")


def test_ranges(spark):
    assert rows(rg.merge_ranges(ranges(spark, (10, 19), (0, 9), (5, 25)), ["g"])) == [("d", 0, 25)]
    assert rows(rg.merge_ranges(ranges(spark, (0, 1), (3, 4), (7, 6), (3, 4)), ["g"])) == [("d", 0, 1), ("d", 3, 4)]
    assert rows(rg.merge_ranges(ranges(spark), ["g"])) == []
    wide = rg.align(ranges(spark, (100, 4095), (8192, 9000), (20000, 20001)), 4096, F.lit(16384), ["g"])
    assert rows(wide) == [("d", 0, 4095), ("d", 8192, 12287)]
    plan = rg.chunk_plan(rg.align(ranges(spark, (7192, 9191)), 4096, F.lit(9192), ["g"]), 4096, ["g"])
    assert rows(plan) == [("d", 1, 4096, 4096), ("d", 2, 8192, 1000)]
    big = 2**62 - 4096 * 5
    assert rows(rg.align(ranges(spark, (big + 1, big + 2)), 4096, F.lit(2**62), ["g"])) == [("d", big, big + 4095)]
    assert {r[3] for r in rows(rg.range_violations(ranges(spark, (0, 5), (5, 9), (20, 10)), ["g"]))} == {"overlap", "reversed"}


def test_merge_and_complement_cover_everything(spark):
    dice = random.Random(1)
    pairs = [(a, a + dice.randrange(9)) for a in (dice.randrange(200) for _ in range(40))]
    used = {x for a, b in pairs for x in range(a, b + 1) if x < 200}
    free = {x for _, a, b in rows(rg.complement(ranges(spark, *pairs), ["g"], F.lit(0), F.lit(199))) for x in range(a, b + 1)}
    assert used | free == set(range(200)) and not used & free


def test_overlap_join_meets_each_pair_once(spark):
    dice = random.Random(2)
    p = [(i, a, a + dice.randrange(60)) for i, a in enumerate(dice.randrange(500) for _ in range(40))]
    q = [(i, a, a + dice.randrange(90)) for i, a in enumerate(dice.randrange(500) for _ in range(15))]
    points = spark.createDataFrame([("x", *r) for r in p], "k string, i int, start bigint, end_incl bigint")
    areas = spark.createDataFrame([("x", *r) for r in q], "k string, j int, lo bigint, hi bigint")
    got = rows(rg.overlap_join(points, areas, ["k"], 16).select("i", "j", "clip_start", "clip_end"))
    assert got == sorted([(i, j, max(a, c), min(b, e)) for i, a, b in p for j, c, e in q if a <= e and b >= c], key=repr)


def test_holes(spark):
    df = spark.createDataFrame([(1, [(0, 4), (8, 2)], 10), (2, [(4, 2), (3, 1), (5, 0), (9, 9)], 10), (3, None, 5), (4, [], 0)], "k int, holes array<struct<o:bigint,n:bigint>>, size bigint")
    assert rows(rg.data_ranges(df.where("k <> 2"), ["k"], "holes", "o", "n", "size")) == [(1, 4, 7), (3, 0, 4)]
    assert [r[2] for r in rows(rg.hole_violations(df, ["k"], "holes", "o", "n", "size"))] == ["order", "empty", "beyond_end"]


STATE = "chunk_no bigint, state int, hash string"


def test_delta_and_change(spark):
    parent = spark.createDataFrame([(0, 1, "01"), (1, 2, None), (2, 1, "02"), (3, 0, None), (4, 1, "03")], STATE)
    delta = spark.createDataFrame([(1, 1, "AA"), (3, 2, None)], STATE)
    got = rows(ch.upsert(parent, delta, ["chunk_no"], ["state", "hash"]).select("chunk_no", "state", "hash"))
    assert got == [(0, 1, "01"), (1, 1, "AA"), (2, 1, "02"), (3, 2, None), (4, 1, "03")]
    scan = spark.createDataFrame([(0, 1, "01"), (1, 3, None), (2, 1, "09"), (7, 2, None)], STATE)
    assert [(r["chunk_no"], r["outcome"]) for r in sorted(ch.scan_diff(parent, scan, ["chunk_no"]).collect())] == [(0, "inherited"), (1, "bad"), (2, "stored"), (3, "inherited"), (4, "unused"), (7, "zero")]
    bad = spark.createDataFrame([(0, 3, None)], STATE)
    assert ch.scan_diff(bad, bad, ["chunk_no"]).first()["outcome"] == "bad"


def test_newest_state_and_packing(spark):
    e = spark.createDataFrame([("c", 0, 0, 1), ("c", 0, 2, 0), ("c", 1, 1, 1), ("c", 0, 1, 3)], "chain string, chunk int, seq int, state int")
    assert rows(ch.newest_state(e, ["chain", "chunk"], "seq", ["state"])) == [("c", 0, 2, 0), ("c", 1, 1, 1)]
    assert rows(ch.newest_state(e, ["chain", "chunk"], "seq", ["state"], upto=F.lit(1))) == [("c", 0, 1, 3), ("c", 1, 1, 1)]
    packed = ch.pack_state(F.lit(3), F.lit(0x3FFE))
    assert one(spark, packed, *ch.unpack_state(packed)) == (0xFFFE, 3, 0x3FFE)


MEMBERS = "chain_id string, image_uuid string, parent_uuid string, seq_in_chain int, member_kind string, created_unix bigint, size_bytes bigint, verified_unix bigint, set_id string"


def test_chains(spark):
    m = spark.createDataFrame([("ok", "a", None, 0, "full", 1, 5, 1, "s"), ("ok", "b", "a", 1, "incremental", 2, 5, 1, "s"), ("gap", "c", None, 0, "full", 1, 5, None, "s"), ("gap", "d", "c", 2, "incremental", 1, 5, 1, "s"), ("nofull", "e", "x", 0, "incremental", 1, 5, 1, "s")], MEMBERS)
    assert {r["chain_id"]: (r["is_complete"], r["is_verified"]) for r in ch.completeness(m).collect()} == {"ok": (True, True), "gap": (False, False), "nofull": (False, True)}
    assert rows(ch.link_warnings(m).select("image_uuid", "check_id")) == [("e", "parent_before_first")]
    assert {r["image_uuid"]: (r["n_ancestry"], r["has_gap"]) for r in ch.ancestry(m).collect()} == {"a": (1, False), "b": (2, False), "c": (1, False), "d": (2, True), "e": (1, False)}


def plan(spark, chains):
    df = spark.createDataFrame([("s", *c) for c in chains], "set_id string, chain_id string, created_unix bigint, size_bytes bigint, is_complete boolean, is_verified boolean, keep_chains int")
    return {r["chain_id"]: r["decision"] for r in rt.retention_plan(df).collect()}


def test_retention(spark):
    got = plan(spark, [("a", 1, 5, True, False, 1), ("b", 2, 5, True, True, 1), ("c", 3, 5, True, True, 1), ("d", 9, 5, True, False, 1), ("old", 2, 5, False, False, 1), ("new", 10, 5, False, False, 1)])
    assert got == {"d": "keep", "c": "keep_verified", "b": "delete", "a": "delete", "old": "delete_incomplete", "new": "keep_recent"}
    assert plan(spark, [("a", 1, 5, True, False, 0), ("b", 1, 5, True, True, None)]) == {"b": "keep", "a": "delete"}


def test_functions(spark):
    v = lambda f, x: one(spark, f(F.lit(x)))[0]
    assert [v(tx.parse_size, x) for x in ("512KiB", "4MiB", " 7 ", "1GiB", "3B", "x", "1.5MiB", "99999999TiB", None)] == [524288, 4 << 20, 7, 1 << 30, 3, None, None, None, None]
    assert [v(tx.human_size, x) for x in (0, 1023, 1024, 1536, 5 << 30)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "5.0 GiB"]
    assert [v(tx.valid_name, x) for x in ("a", "a.b-c_9", ".a", "", "a b", "a" * 65, "a\n", None)] == [True, True, False, False, False, False, False, False]
    assert v(tx.created_at, 0) == "1970-01-01 00:00 UTC" and v(tx.created_at, -1) == "unknown" and v(tx.created_at, 2**62) == "unknown"
    assert one(spark, *tx.kernel_version(F.lit("6.12.96-amd64"))) == (6, 12) and one(spark, *tx.kernel_version(F.lit("7+x"))) == (7, 0)
    assert v(tx.escape_subvolume, "/a%b/c/") == "a%25b%2Fc" and v(tx.escape_subvolume, "/") == "FS_TREE"
    assert one(spark, *tx.subvolume_options(F.lit("rw,subvolid=5,subvol=/@home"))) == ("/@home", 5)
    assert [tuple(r) for r in v(tx.parse_ranges, "1-5, 9,12-20")] == [(1, 5), (9, 9), (12, 20)]
    assert [v(tx.is_zero, x) for x in (b"", b"\0\0", b"\0\1")] == [True, True, False]
    assert [one(spark, tx.io_class(F.lit(f), F.lit(n)))[0] for f, n in (("R", 8), ("FR", 8), ("F", 8), ("WS", 8), ("D", 0), ("RA", 1))] == ["read", "read", "dirty", "dirty", "none", "read"]
    assert one(spark, *tx.split_image(F.lit("@n/set/chain/f"))) == ("@n", "set", "chain/f") and one(spark, *tx.split_image(F.lit("a/b")))[0] is None
    assert [v(tx.plain_path, x) for x in ("", "a/b", "a//b", "../a", "a/.")] == [True, True, False, False, False]
    assert v(tx.mbr_name, "8E") == "Linux LVM" and v(tx.mbr_name, "99") == "unknown"


def test_dirty_map(spark):
    events = [("7:0", "W", 67584, 8), ("7:2", "W", 3 * 2048 + 5, 1), ("7:0", "W", 67584 + 5 * 2048 + 2040, 16), ("7:0", "W", 0, 2048), ("7:0", "W", 67584 + 8 * 2048, 2048), ("8:0", "W", 67584, 8), ("7:0", "R", 67584, 8), ("7:0", "W", 67584 - 4, 8)]
    regions = spark.createDataFrame([("7:0", "7:2", 1, 67584, 67584 + 16383)], "dev string, part_dev string, region int, lo bigint, hi bigint")
    df = spark.createDataFrame(events, "dev string, flags string, sector bigint, sectors bigint")
    dirty = tr.dirty_chunks(df, regions, 2048)
    assert rows(dirty) == [(1, n) for n in (0, 3, 5, 6)]
    assert rows(tr.coarsen(dirty, 4)) == [(1, 0), (1, 1)]
    assert tr.bitmap_union(tr.bitmaps(dirty)).agg(F.sum("n_dirty")).first()[0] == 4  # chunk 0 has a bucket of its own


def test_convergence(spark):
    def told(*passes):
        df = spark.createDataFrame([("c", i, float(d), float(r), 1.0, h) for i, (d, r, h) in enumerate(passes)], "copy string, pass_no int, dirty_mib double, read_mib double, seconds double, is_held boolean")
        return [r["decision"] for r in tr.convergence(df, ["copy"]).orderBy("pass_no").collect()]

    assert told((64, 100, False)) == ["final"] and told((65, 1000, False)) == ["again"] and told((32, 20, False)) == ["again"] and told((0, 0, False)) == ["final"]
    shrinking = [(d, 1000, False) for d in range(1000, 0, -100)]
    assert told(*shrinking, (100, 1000, False), (120, 1000, False), (50, 1000, False)) == ["again"] * 11 + ["give_up", None]
    assert told((1, 100, True), (0.5, 100, True)) == ["wait", "give_up"] and told((1, 100, True), (1, 100, False), (1, 100, False)) == ["wait", "final", None]


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 200_000), st.integers(0, 2**32))
def test_content_defined_chunks(n, seed):
    data = random.Random(seed).randbytes(n)
    ends = ck.cut_points(data, 1024, 4096, 16384)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == n and all(s <= 16384 for s in sizes) and all(s > 0 for s in sizes) and all(s >= 1024 for s in sizes[:-1])
    assert ends == ck.cut_points(data, 1024, 4096, 16384)


def test_cuts_follow_the_content():
    data = random.Random(1).randbytes(300_000)
    a, b = ck.cut_points(data, 1024, 4096, 16384), ck.cut_points(b"xyz" + data, 1024, 4096, 16384)
    assert len({x + 3 for x in a} & set(b)) > 0.8 * len(a)


def test_files(spark):
    e = spark.createDataFrame([("c", b"", b"", 2), ("c", b"a", b"", 2), ("c", b"a/x", b"a", 1), ("c", b"b/y", b"b", 1), ("c", b"a/x/z", b"a/x", 3)], "chain string, path binary, parent_path binary, file_kind int")
    assert [bytes(r["path"]) for r in fl.orphan_paths(e, ["chain"]).collect()] in ([b"b/y", b"a/x/z"], [b"a/x/z", b"b/y"])
    assert [bytes(r["path"]) for r in fl.deepest_first(e, ["chain"]).orderBy("position").collect()] == [b"a/x/z", b"b/y", b"a/x", b"a", b""]
    assert [bytes(r["path"]) for r in fl.restore_order(e, ["chain"]).orderBy("position").collect()] == [b"", b"a", b"a/x", b"b/y", b"a/x/z"]
    c = spark.createDataFrame([(1, "h"), (2, "h"), (3, None), (4, None)], "i int, h string").withColumn("g", F.lit(1))
    assert rows(fl.first_occurrence(c, ["g"], ["h"], ["i"]).select("i", "is_first")) == [(1, True), (2, False), (3, True), (4, False)]


def test_devices(spark):
    df = spark.createDataFrame([("a", "X1", ""), ("b", "x1", ""), ("c", "y", "")], "dev string, partuuid string, fs string")
    assert rows(dv.duplicate_identities(df, "dev", ["partuuid", "fs"])) == [("partuuid", "x1", 2, "a")]
    sub = spark.createDataFrame([("f", "a"), ("f", "a/b"), ("f", "a/b/c"), ("f", "d"), ("f", "d/e")], "fs string, path string")
    assert rows(dv.nested_unmounted(sub, sub.where("path in ('a', 'a/b/c')"), ["fs"])) == [("f", "a/b")]
    tiles = spark.createDataFrame([(1, "x", 0.01), (1, "y", 0.99), (2, "z", 0.0)], "d int, n string, s double")
    assert {r["n"]: round(r["width"], 4) for r in dv.tile_widths(tiles, ["d"], "s").collect()} == {"x": 0.08, "y": 0.92, "z": 1.0}


def test_throttle(spark):
    e = spark.createDataFrame([("j", i, d, 100) for i, d in enumerate((10, 40, 60, 90, 100))] + [("k", 0, 100, 100)], "job_id string, event_no int, done bigint, total bigint")
    assert rows(jb.throttled(e, 50).select("job_id", "done")) == [("j", 100), ("j", 60), ("k", 100)]


@pytest.mark.parametrize("body", [b"", b"a", b"a" * 5000, random.Random(3).randbytes(3000)])
def test_codecs(spark, body):
    df = spark.createDataFrame([(body,)], "b binary").withColumn("z", ck.compress_if_smaller("b"))
    r = df.select("b", "z", ck.decompress("z").alias("back")).first()
    assert (r["z"] is None and len(body) < 50 or r["z"] is None and len(set(body)) > 200) or (len(r["z"]) < len(body) and bytes(r["back"]) == body)
    key, iv, aad = F.lit(b"k" * 32), ck.nonce(F.lit(7)), F.lit(b"x")
    assert bytes(df.select(ck.unseal(ck.seal(F.col("b"), key, iv, aad), key, aad).alias("r")).first()["r"]) == body


def test_partition_enrichment(spark):
    make = spark.createDataFrame
    parts = make([("sda", 1, 34), ("sda", 2, 99), ("sda", 3, 500)], "device string, number int, start_lba bigint")
    kernel = make([("sda", 34, "sda1", "/dev/sda1", "8:1"), ("sda", 99, "sda2", "/dev/sda2", "8:2")], "device string, start_lba bigint, name string, path string, dev string")
    ids = make([("/dev/sda1", "ext4", "u1")], "path string, fs_type string, fs_uuid string")
    mounts = make([("8:1", "/dev/sda1", "/"), ("0:9", "/dev/sda1", "/b"), ("8:7", "x", "/c")], "dev string, source string, mount_point string")
    holders = make([("sda2", "dm-0"), ("sda2", "dm-0")], "name string, holder string")
    got = dv.enriched_partitions(parts, kernel, ids, mounts, holders)
    assert [(r["number"], r["fs_type"], r["mountpoints"], r["holders"]) for r in got.orderBy("number").collect()] == [(1, "ext4", ["/", "/b"], []), (2, None, [], ["dm-0"]), (3, None, [], [])]
    offline = got.where(dv.is_offline(F.col("mountpoints"), F.col("holders"))).collect()
    assert [r["number"] for r in offline] == [3]


def test_payloads_are_read_and_hashed(spark):
    import hashlib

    from vaultlens.operators import verify as vf

    h = lambda b: hashlib.sha256(b).hexdigest()
    entries = spark.createDataFrame([("c", i) for i in range(7)], "chain string, at int")
    records = [("c", 0, 1, b"abc", h(b"abc").upper(), 3), ("c", 1, 1, b"abc", h(b"x"), 3), ("c", 2, 1, b"ab", h(b"ab"), 3), ("c", 3, 1, None, h(b"x"), 3), ("c", 4, 1, b"abc", None, 3), ("c", 6, 1, b"abc", h(b"x"), 3), ("c", 6, 2, b"abc", h(b"abc"), 3), ("d", 5, 1, b"abc", h(b"abc"), 3)]
    df = spark.createDataFrame(records, "chain string, at int, v int, p binary, h string, n int")
    got = {r["at"]: r["verdict"] for r in vf.payload_verdicts(entries, df, ["chain", "at"], ["v"], "h", "p", "n").collect()}
    assert got == {0: "equal", 1: "stale", 2: "short", 3: "no_content", 4: "no_hash", 5: "missing", 6: "equal"}
    assert vf.payload_verdicts(entries, df.limit(0), ["chain", "at"], ["v"], "h", "p", "n").where("verdict = 'missing'").count() == 7


def test_parent_states_skip_members_that_never_came(spark):
    from vaultlens.operators import chains as ch

    own = spark.createDataFrame([("c", 0, 1, 10), ("c", 0, 2, 20), ("c", 3, 1, 11), ("c", 5, 3, 30)], "chain string, seq int, k int, v int")
    got = sorted((r["seq"], r["k"], r["v"]) for r in ch.parent_states(own, ["chain"], ["k"], "seq", ["v"]).collect())
    assert got == [(3, 1, 10), (3, 2, 20), (5, 1, 11), (5, 2, 20)]
