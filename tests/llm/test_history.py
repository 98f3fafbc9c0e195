"""Deduplication against history, held against the definition."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vaultlens.llm import history
from vaultlens.session import cut


def brute(rows, similar=0.7):
    out, accepted = [], {}
    for g, b, i, p in sorted((r for r in rows if None not in r), key=lambda r: r[:3]):
        w = {p[k : k + 8] for k in range(len(p) - 7)}
        hits = [a for a, (q, v) in accepted.setdefault(g, {}).items() if p == q or (w | v and len(w & v) >= similar * len(w | v))]
        out += [(a, i) for a in hits]
        if not hits:
            accepted[g][i] = (p, w)
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "g string, b int, i bigint, p binary, batch string, id int")
    return sorted(map(tuple, history.repeats(df, group="g", batch="b", record_id="i", payload="p", **how).collect()))


def made(seed, n, header=0):
    dice = random.Random(seed)
    head = dice.randbytes(header)
    seeds = [head + dice.randbytes(dice.choice([3, 9, 20, 60, 200])) for _ in range(n // 5)]
    rows = []
    for i in range(n):
        p = bytearray(dice.choice(seeds))
        for _ in range(dice.choice([0, 0, 1, 1, 2, 4])):
            p[dice.randrange(header, len(p))] = dice.randrange(256)
        rows.append((dice.choice("AAB"), dice.randrange(4), 100_000 - i, bytes(p)))
    return rows


@pytest.mark.parametrize("how", [{}, {"hot": 2}, {"hot": 2, "few": 8000}, {"hot": 1, "crowd": 2, "few": 1 << 40}])
@pytest.mark.parametrize("header", [0, 40])
def test_matches_the_definition(spark, how, header):
    rows = made(header + 1, 150, header)
    assert run(spark, rows, **how) == brute(rows)


def test_edges(spark):
    long = bytes(random.Random(4).randbytes(70_000))
    rows = [("A", 0, 1, b""), ("A", 1, 2, b""), ("A", 0, 3, b"short"), ("A", 0, 4, b"short"), ("A", 0, 5, b"shorT"), ("A", 0, 6, None), (None, 0, 7, b"short"), ("A", None, 8, b"short"), ("B", 0, 9, b"short"), ("A", 0, 10, long), ("A", 2, 11, long[:-1]), ("A", 2, 12, bytes(300)), ("A", 2, 13, bytes(400))]
    assert run(spark, rows) == [(1, 2), (3, 4), (10, 11), (12, 13)]
    assert run(spark, []) == []


def test_decisions_of_large_and_small_groups_agree(spark):
    dice = random.Random(6)
    edges = [(g, a, b) for g in (1, 2) for a, b in {tuple(sorted(dice.sample(range(g * 100, g * 100 + 40), 2))) for _ in range(60)}]
    df = cut(spark.createDataFrame([(*e, True) for e in edges] + [(2, 5, 205, False)], "grp bigint, a bigint, b bigint, own boolean"))
    one, many = (sorted(map(tuple, history._refused(df, local).collect())) for local in (1000, 10))
    assert one == many != []
    with pytest.raises(RuntimeError):
        history._refused(df, 10, max_rounds=1)


def stored(spark, folder, rows):
    df = spark.createDataFrame(rows, "g string, b int, i bigint, p binary")
    history.sketches(df, group="g", batch="b", record_id="i", payload="p").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def test_a_batch_meets_stored_arrays_only(spark, tmp_path):
    rows = made(11, 160)
    folder, source = str(tmp_path / "history"), str(tmp_path / "batch")
    for k in range(4):
        # a new object and a new source each time: nothing but the folder is left of the batches before
        history.History(spark, folder, parts=3).add(stored(spark, source, [r for r in rows if r[1] == k]))
    h = history.History(spark, folder)
    assert sorted(map(tuple, h.pairs().collect())) == brute(rows)
    assert h.state["parts"] == 3 and h.state["calls"] == 4
    assert len(h.state["segments"]) == 1 and len(list((tmp_path / "history").glob("segment-*"))) == 1
    told = {b for _, b in brute(rows)}
    assert sorted(r["id"] for r in h.accepted().select("id").collect()) == sorted(r[2] for r in rows if r[2] not in told)


def test_later_copies_of_a_refused_record_meet_what_was_accepted_between(spark):
    dice = random.Random(3)
    a = dice.randbytes(200)
    b, c = a[20:] + dice.randbytes(20), a[40:] + dice.randbytes(40)
    c = b[20:] + dice.randbytes(20)
    for batches in ((0, 0, 0, 0), (0, 1, 1, 2)):
        rows = [("A", k, i, p) for i, (k, p) in enumerate(zip(batches, (a, b, c, b)), 1)]
        assert run(spark, rows) == brute(rows) == [(1, 2), (1, 4), (3, 4)]


def test_a_cluster_is_taken_in_parts(spark, monkeypatch):
    dice = random.Random(12)
    base = dice.randbytes(300)
    rows = []
    for i in range(400):
        p = bytearray(base)
        for _ in range(dice.randrange(1, 6)):
            p[dice.randrange(300)] = dice.randrange(256)
        rows.append(("A", 0, i, bytes(p)))
    parted = []
    monkeypatch.setattr(history.History, "_in_parts", lambda self, *x, f=history.History._in_parts: parted.append(x[1]) or f(self, *x))
    assert run(spark, rows, few=50_000, hot=16) == brute(rows)
    assert parted


def test_chain_of_decisions(spark):
    dice = random.Random(9)
    base = dice.randbytes(200)
    rows = []
    for k in range(12):  # each differs from the next by little, from later ones by much
        rows.append(("A", k % 3, k + 1, base))
        base = base[25:] + dice.randbytes(25)
    assert run(spark, rows) == brute(rows) != []


def test_arrays_keep_their_order_and_content():
    dice = np.random.default_rng(2)
    cells = lambda n: (dice.integers(-3, 3, n), dice.integers(-(2**63), 2**63 - 1, n), dice.integers(-50, 50, n), dice.integers(1, 9, n).astype(np.int32))
    a, b = (history.SuffixArray.of(*cells(n)) for n in (200, 300))
    whole = history.SuffixArray.load(history.SuffixArray.merged([a, b]).dump())
    groups = np.unique(whole[0])
    assert (np.diff(whole.codes(groups).astype(object)) >= 0).all()
    assert sorted(zip(*(x.tolist() for x in whole))) == sorted([*zip(*(x.tolist() for x in a)), *zip(*(x.tolist() for x in b))])


def _smallest(p, keep=24):
    """Windows of smallest hash, by the hash that chose a record's only entries before."""
    w = history.windows(p)
    h = w * history.MUL
    h ^= h >> np.uint64(32)
    h *= history.MUL2
    h ^= h >> np.uint64(29)
    return {int(x).to_bytes(8, "big") for x in w[np.argsort(h)[:keep]]}


def test_a_pair_is_found_whichever_windows_differ(spark):
    base = random.Random(21).randbytes(2000)
    near = bytearray(base)
    for w in _smallest(base):  # each of them is lost, all others stay
        near[base.index(w) + 3] ^= 1
    rows = [("A", 0, 1, base), ("A", 0, 2, bytes(near)), ("A", 1, 3, base[:1700])]
    assert not _smallest(base) & _smallest(bytes(near))
    assert run(spark, rows) == brute(rows) == [(1, 2), (1, 3)]


def _first_windows(payloads, costs):
    got = [set() for _ in payloads]
    for own, window, _, _ in history.prefixes(pa.array(payloads, pa.binary()), costs, 0.7):
        for i, w in zip(own.tolist(), window.tolist()):
            got[i].add(w)
    return got


@pytest.mark.parametrize("alphabet", [2, 12, 256])
def test_similar_payloads_agree_in_their_first_windows(alphabet):
    dice = random.Random(alphabet)
    costs = np.random.default_rng(alphabet).integers(0, 160, history.SLOTS).astype(np.uint8)
    checked = 0
    for size in [8, 9, 10, 12, 15, 20, 40, 90, 300] * 40:
        a = bytes(dice.randrange(alphabet) for _ in range(size))
        b = bytearray(a)
        for _ in range(dice.randrange(1, 2 + size // 30)):
            b[dice.randrange(len(b))] = dice.randrange(alphabet)
        b = bytes(b)[dice.choice([0, 0, size // 10]) :]
        v, w = ({p[k : k + 8] for k in range(len(p) - 7)} for p in (a, b))
        if v and w and len(v & w) >= 0.7 * len(v | w):
            x, y = _first_windows([a, b], costs)
            assert len(x & y) >= min(history.COVERAGE, len(v & w))
            checked += 1
    assert checked > 20


def test_windows_that_many_records_share_come_last(spark):
    dice = random.Random(5)
    line = b"a header that stands in all of the records, over and over; "
    texts = [line + dice.randbytes(60) for _ in range(300)]
    costs = history.rarities(spark.createDataFrame([(t,) for t in texts], "payload binary"))
    rare, flat = (_first_windows(texts, c) for c in (costs, np.zeros_like(costs)))
    shared = lambda got: len(set.intersection(*got))
    assert shared(rare) == 0
    assert sum(len(x & y) for x, y in zip(rare, rare[1:])) == 0 < sum(len(x & y) for x, y in zip(flat, flat[1:]))
