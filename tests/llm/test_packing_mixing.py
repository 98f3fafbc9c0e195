"""Containers and mixes."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vaultlens.llm import mixing, packing
from vaultlens.llm.tokens import encoder, token_counts
from vaultlens.session import cut


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 5), st.floats(0.01, 3)), min_size=1, max_size=6), st.integers(30, 60))
def test_knapsack_is_best(items, capacity):
    sizes, bounds, values = (np.array(x) for x in zip(*items))
    a = packing.best_pattern(sizes, values, bounds, capacity)
    assert (a * sizes).sum() <= capacity and (a <= bounds).all()
    best = np.full(capacity + 1, 0.0)
    for s, b, v in zip(sizes, bounds, values):
        for _ in range(b):
            best[s:] = np.maximum(best[s:], best[:-s] + v)
    assert (a * values).sum() == pytest.approx(best[capacity])


def packed(spark, sizes, specs, **how):
    df = cut(spark.createDataFrame([(*r, 5, "x") for r in sizes], "doc_id bigint, n_tokens bigint, spec_id int, bucket string"))
    return [tuple(r) for r in packing.pack(df, specs, **how).collect()]


def check(rows, sizes, specs):
    for spec, capacity in specs:
        own = [r for r in rows if r[0] == spec]
        load, pieces = Counter(), defaultdict(list)
        for _, box, doc, piece, n in own:
            load[box] += n
            pieces[doc].append((piece, n))
        assert max(load.values(), default=0) <= capacity
        assert set(load) == set(range(len(load)))
        for doc, n in sizes:
            if n is None:
                assert doc not in pieces
                continue
            got = [k for _, k in sorted(pieces[doc])]
            assert sum(got) == n and [p for p, _ in sorted(pieces[doc])] == list(range(len(got)))
            assert len(got) == max(1, -(-n // capacity))
        yield len(load)


def test_pack_everything_once(spark):
    dice = random.Random(2)
    sizes = [(i, min(20_000, int(dice.lognormvariate(5, 1)))) for i in range(900)] + [(1000 + i, 512) for i in range(5)] + [(2000, 0), (2001, None), (2002, 5000), (2003, 1)]
    specs = [(1, 512), (2, 2048)]
    rows = packed(spark, sizes, specs)
    for n, (_, capacity) in zip(check(rows, sizes, specs), specs):
        assert n <= 1.05 * sum(x or 0 for _, x in sizes) / capacity + 2


def test_pack_one_hot_length_and_small_patterns(spark):
    sizes = [(i, 100) for i in range(400)] + [(400 + i, 33 + i % 50) for i in range(300)]
    rows = packed(spark, sizes, [(7, 300)], most_classes=8)
    assert next(check(rows, sizes, [(7, 300)])) <= 1.12 * sum(n for _, n in sizes) / 300


@pytest.mark.parametrize("capacity", [512, 2048, 8192])
def test_the_plan_on_the_driver_does_not_grow_with_the_items(capacity):
    dice = np.random.default_rng(4)
    lengths, counts = np.unique(np.minimum(dice.lognormal(5, 1.2, 20_000).astype(int) + 1, capacity - 1), return_counts=True)
    rows = {}
    for times in (1, 100, 10_000, 1_000_000):
        cls, table, boxes = packing.plan(lengths, counts * times, capacity)
        rows[times] = len(table)
        assert boxes <= lengths @ (counts * times) / (0.985 * capacity) + 1
        # every item of every class has a place: the rows of a class cover its ranks without gaps
        ends = table[:, 1] + 0
        for c in range(cls.max() + 1):
            own = np.flatnonzero(table[:, 0] == c)
            assert ends[own[0]] == 0 and (np.diff(ends[own]) > 0).all()
    # the number of rows goes with the logarithm of the number of items
    assert rows[1_000_000] - rows[10_000] <= 1.1 * (rows[10_000] - rows[100]) and rows[1_000_000] < 130_000


def test_pack_nothing(spark):
    assert packed(spark, [], [(1, 512)]) == []
    assert packed(spark, [(1, 0)], [(1, 512)]) == [(1, 0, 1, 0, 0)]
    assert sorted(packed(spark, [(1, 1024)], [(1, 512)])) == [(1, 0, 1, 0, 512), (1, 1, 1, 1, 512)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0.01, 1), min_size=1, max_size=6))
def test_schedule_stays_within_one_block(weights):
    quota = mixing.quotas(weights, 200)
    slots = mixing.schedule(quota)
    assert sorted(t for s in slots for t in s) == list(range(200)) and [len(s) for s in slots] == quota
    for q, own in zip(quota, slots):
        done = np.searchsorted(own, np.arange(201))
        assert (abs(done - np.arange(201) * q / 200) < 1).all()


TARGETS = [(1, "a", 0.5, 1), (1, "b", 0.3, 4), (1, "c", 0.2, 2), (2, "a", 0.6, 2), (2, "none", 0.4, 3)]


def mixed(spark, sizes):
    df = cut(spark.createDataFrame([(*r, 1) for r in sizes], "doc_id bigint, source string, n_tokens bigint, at int"))
    drawn, aims = mixing.mix(df, TARGETS, block=64)
    return drawn.cache(), aims


def test_mix(spark):
    dice = random.Random(3)
    sizes = [(i, dice.choice("aaaaaaabcd"), dice.randrange(0, 60)) for i in range(3000)] + [(9000, "a", None), (9001, None, 5)]
    drawn, aims = mixed(spark, sizes)
    size = {i: n for i, _, n in sizes}
    rows = drawn.collect()
    assert all(r["n_tokens"] == size[r["doc_id"]] for r in rows)
    count = Counter((r["mix_id"], r["doc_id"]) for r in rows)
    limit = {(m, s): k for m, s, _, k in TARGETS}
    source = {i: s for i, s, _ in sizes}
    assert all(k <= limit[m, source[i]] for (m, i), k in count.items())
    assert len({(r["mix_id"], r["doc_id"], r["repeat_no"]) for r in rows}) == len(rows)
    got = {(r["mix_id"], r["source"]): r for r in mixing.shares(drawn, TARGETS).collect()}
    for (m, s), aim in aims.items():
        assert abs(got[m, s]["n_tokens"] - aim) <= 30
    assert got[1, "b"]["actual_share"] == pytest.approx(0.3, abs=0.01) and got[1, "b"]["repeats"] > 1
    assert got[2, "none"]["actual_share"] == 0 and got[2, "a"]["actual_share"] == 1
    # every prefix of the schedule holds the shares within a block (and one text) per source
    total, line = Counter(), Counter()
    for r in sorted((r for r in rows if r["mix_id"] == 1), key=lambda r: r["slot"]):
        total["all"] += r["n_tokens"]
        line[r["source"]] += r["n_tokens"]
        assert abs(line["a"] - 0.5 * total["all"]) <= 2 * 64 + 120


def test_a_tiny_source_does_not_shrink_the_mix(spark):
    targets = [(1, "a", 0.5, 1), (1, "b", 0.3, 2), (1, "tiny", 0.2, 3)]
    aims = [mixing.amounts(targets, {"a": 50_000, "b": 20_000, "tiny": n}) for n in (0, 1, 40)]
    assert [(x[1, "a"], x[1, "b"], x[1, "tiny"]) for x in aims] == [(50_000, 30_000, n) for n in (0, 3, 120)]
    # a source that is merely scarce still keeps all shares, and a rich one of tiny share changes nothing
    assert mixing.amounts(targets, {"a": 50_000, "b": 20_000, "tiny": 4_000}) == {(1, "a"): 30_000, (1, "b"): 18_000, (1, "tiny"): 12_000}
    assert mixing.amounts([(1, "a", 0.5, 1), (1, "b", 0.499, 1), (1, "rich", 0.001, 1)], {"a": 500, "b": 499, "rich": 100_000}) == {(1, "a"): 500, (1, "b"): 499, (1, "rich"): 1}
    sizes = [(i, "a", 50) for i in range(1000)] + [(2000 + i, "b", 50) for i in range(400)] + [(3000, "tiny", 40)]
    df = cut(spark.createDataFrame(sizes, "doc_id bigint, source string, n_tokens bigint"))
    got = {r["source"]: r for r in mixing.shares(mixing.mix(df, targets, block=64)[0], targets).collect()}
    assert {s: (r["n_tokens"], r["repeats"]) for s, r in got.items()} == {"a": (50_000, 1), "b": (30_000, 2), "tiny": (120, 3)}
    assert got["tiny"]["actual_share"] == pytest.approx(120 / 80_120)


def test_mix_of_nothing(spark):
    drawn, _ = mixed(spark, [])
    assert drawn.count() == 0
    assert all(r["n_tokens"] == 0 for r in mixing.shares(drawn, TARGETS).collect())


def test_running_sums_are_exact_in_any_number_of_buckets(spark):
    sizes = spark.createDataFrame([(i, "ab"[i % 3 == 0], i % 7) for i in range(500)], "doc_id bigint, source string, n_tokens bigint")
    one, many = (sorted(map(tuple, mixing.running(sizes, n).collect())) for n in (10_000, 20))
    assert one == many
    for s in "ab":
        own = sorted((r[3], r[2]) for r in one if r[1] == s)
        assert own[0][0] == 0 and max(a + n for a, n in own) == sum(n for _, n in own)


def test_tokens_are_counted_over_whole_texts(spark):
    texts = ["", "héllo wörld", "<|endoftext|> x", "a" * 100_000, None]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, t string"), "t", ["doc_id"]).collect()}
    assert got == {i: len(encoder().encode_ordinary(t)) for i, t in enumerate(texts) if t is not None}
