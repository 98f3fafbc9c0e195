"""Cuckoo tables and the seen-before operator."""

import shutil

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultlens.llm import seen


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, min_size=1, max_size=400), st.integers(0, 400))
def test_no_key_is_missed_and_deletion_keeps_the_rest(keys, cut_at):
    keys = np.array(keys, np.uint64)
    t = seen.GrowingCuckoo(buckets=4)
    t.add(keys)
    assert t.has(keys).all() and len(t.tables) >= 1
    gone, kept = keys[:cut_at], keys[cut_at:]
    assert t.remove(gone).all()
    assert t.has(kept).all()


def test_growth_memory_and_error_rate():
    dice = np.random.default_rng(3)
    keys = dice.integers(0, 2**63, 200_000, dtype=np.uint64)
    most = 0.0
    for bits in (16, 32):
        t, n = seen.GrowingCuckoo(buckets=256, bits=bits), 0
        for part in np.array_split(keys, 400):
            part = np.unique(part)
            t.add(part[~t.has(part)])
            n += len(part)
            if bits == 32 and n > 4000:
                most = max(most, t.nbytes / n)
        assert t.has(keys).all() and len(t.tables) > 3
        assert t.has(dice.integers(2**63, 2**64 - 1, 200_000, dtype=np.uint64)).mean() <= (1e-3 if bits == 16 else 1e-5)
        again = seen.GrowingCuckoo.load(t.dump())
        assert again.has(keys).all() and again.nbytes == t.nbytes
    assert 4.4 < most < 9.9


def test_removing_many_keys_loses_none():
    dice = np.random.default_rng(5)
    keys = np.unique(dice.integers(0, 2**63, 400_000, dtype=np.uint64))
    dice.shuffle(keys)
    for bits in (12, 32):
        t = seen.GrowingCuckoo(bits=bits)
        for part in np.array_split(keys, 10):
            t.add(part)
        assert len(t.tables) > 5 and (len(t.exact) > 0) == (bits == 12)
        gone, kept = keys[::4], np.delete(keys, np.arange(0, len(keys), 4))
        assert t.remove(gone).all()
        assert t.has(kept).all()
        if bits == 32:
            assert not t.has(gone).any()
            assert t.remove(kept).all() and not t.has(kept).any() and sum(x.used for x in t.tables) == 0


def test_saturated_table_uses_its_stash():
    t = seen.CuckooTable(2)
    keys = np.arange(1, 20, dtype=np.uint64)
    t.add(keys, kicks=5)
    assert t.has(keys).all() and len(t.stash) and t.remove(keys).all() and not t.has(keys).any()


def stream(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id bigint, b int, key binary, k1 int, place int")
    return seen.keyed(df, "s", record_id="id", order="b", key=[F.col("key")])


def found(spark, rows, **how):
    return sorted(r["record_id"] for r in seen.seen_before(stream(spark, rows), **how).collect())


def test_seen_before(spark):
    rows = [(1, 2, b"x"), (2, 1, b"x"), (3, 1, b"x"), (4, 0, None), (5, 0, None), (6, 0, b""), (7, 0, b""), (8, None, b"y"), (9, -5, b"y"), (10, 3, b"z" * 100_000), (11, 3, b"z" * 100_000)]
    assert found(spark, rows) == [1, 3, 7, 9, 11]
    assert found(spark, []) == []


def test_wrong_claims_are_counted(spark):
    dice = np.random.default_rng(1)
    rows = [(i, int(dice.integers(9)), bytes([7]) if i % 3 == 0 else int(dice.integers(3000)).to_bytes(2, "big")) for i in range(6000)]
    want, known = [], set()
    for i, b, k in sorted(rows, key=lambda r: (r[1], r[0])):
        if k in known:
            want.append(i)
        known.add(k)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # many batches, so that the tables are asked
    try:
        assert found(spark, rows) == sorted(want)
        few = found(spark, rows, bits=5)
        r = seen.audit(stream(spark, rows), bits=5).first()
        exact = seen.audit(stream(spark, rows)).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(few) >= set(want) and len(few) == r["n_claims"]
    assert r["n_claims"] - r["n_wrong"] == len(want) and r["n_wrong"] > 0 and 0 < r["wrong_rate"] < 1
    assert exact["n_wrong"] == 0 and exact["wrong_rate"] == 0


def test_a_later_batch_asks_the_stored_tables_only(spark, tmp_path):
    def ids(df):
        return sorted(r["record_id"] for r in df.collect())

    source, folder = str(tmp_path / "batch"), str(tmp_path / "tables")
    one = [(i, 1, str(i % 700).encode()) for i in range(1000)]
    stream(spark, one).write.parquet(source)
    assert ids(seen.SeenStore(spark, folder, parts=3).ask(spark.read.parquet(source))) == list(range(700, 1000))
    shutil.rmtree(source)  # what was asked before isn't needed any more
    two = [(2000 + i, 2, str(600 + i % 200).encode()) for i in range(300)]
    again = seen.SeenStore(spark, folder)
    assert again.parts == 3 and again.version == 1
    assert ids(again.ask(stream(spark, two))) == [2000 + i for i in range(300) if i % 200 < 100 or i >= 200]
    assert ids(again.forget(stream(spark, [(1, 1, b"5"), (2, 1, b"650"), (3, 1, b"never")]))) == [1, 2]
    last = seen.SeenStore(spark, folder)
    assert last.version == 3
    assert ids(last.ask(stream(spark, [(1, 1, b"5"), (2, 1, b"650"), (3, 1, b"6"), (4, 1, b"799"), (5, 2, b"5")]))) == [3, 4, 5]
    assert ids(last.ask(stream(spark, []))) == []
    assert ids(last.ask(stream(spark, [(9, 1, b"650")]))) == [9]
