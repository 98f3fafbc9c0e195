"""Shared spans, held against all windows of all texts."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultlens.llm import spans as sp


def test_cover_has_every_difference():
    assert {(a - b) % sp.PERIOD for a in sp.COVER for b in sp.COVER} == set(range(sp.PERIOD))


def brute(rows, least=240):
    at, cover = defaultdict(set), {}
    for i, t in rows:
        for k in range(len(t or "") - least + 1):
            at[t[k : k + least]].add(i)
    pairs = {(a, b) for v in at.values() for a in v for b in v if a < b}
    for i, t in rows:
        own = set()
        for k in range(len(t or "") - least + 1):
            if len(at[t[k : k + least]]) > 1:
                own |= set(range(k, k + least))
        cover[i] = len(own)
    return sorted(pairs), cover


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, label int, n string")
    spans = sp.shared_spans(df, id_col="doc_id", text_col="text", **how)
    pairs = sorted(map(tuple, sp.shared_pairs(spans).collect()))
    shares = {r["doc_id"]: r["n_shared"] for r in sp.shared_shares(spans).collect()}
    return pairs, shares


def made(seed, n):
    dice = random.Random(seed)
    word = lambda k: "".join(dice.choice("abcdefgh äß漢🙂") for _ in range(k))
    stock = [word(k) for k in (239, 240, 241, 300, 700)]
    boiler = word(200)
    rows = []
    for i in range(n):
        parts = [word(dice.randrange(200))]
        for _ in range(dice.randrange(3)):
            s = dice.choice(stock)
            a = dice.choice([0, 0, 1, 50])
            parts += [s[a:], word(dice.randrange(150)), boiler, word(dice.randrange(1, 90))]
        rows.append((n - i, "".join(parts)))
    return rows + [(n + 1, rows[0][1]), (n + 2, None), (n + 3, ""), (n + 4, "z" * 5000), (n + 5, "z" * 239), (n + 6, "z" * 1000), (n + 7, "")]


@pytest.mark.parametrize("how", [{}, {"hot": 3}, {"hot": 1, "crowd": 4}, {"crowd": 2}])
def test_pairs_and_shares(spark, how):
    rows = made(7, 30)
    pairs, cover = brute(rows)
    got, shares = run(spark, rows, **how)
    assert got == pairs
    assert {i: n for i, n in cover.items() if i in shares} == shares and len(shares) == len(rows) - 1


def test_no_rows(spark):
    assert run(spark, []) == ([], {})


def test_classes(spark):
    rows = made(5, 25)
    pairs, _ = brute(rows)
    text = dict(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in sp.shared_classes(sp.shared_spans(df, id_col="doc_id", text_col="text", hot=4)).collect()}
    assert set(got) == {i for i, t in rows if t is not None}
    for i, r in got.items():
        same = [k for k, t in rows if t == text[i]]
        assert r["class_id"] == min(same) and r["n_copies"] == len(same)
        assert r["n_links"] == len({text[b if a == i else a] for a, b in pairs if i in (a, b)} - {text[i]})


def test_a_passage_of_many_texts_is_not_paired_window_by_window(spark):
    dice = random.Random(2)
    word = lambda k: "".join(dice.choice("abcdefgh") for _ in range(k))
    passage = word(400)
    rows = [(i, word(dice.randrange(300)) + passage + word(dice.randrange(300))) for i in range(300)]
    # a place of the passage is an anchor in some 33 of the texts
    spans = sp.shared_spans(spark.createDataFrame(rows, "doc_id bigint, text string"), id_col="doc_id", text_col="text", hot=8)
    # one row per text and window of the passage, one set of texts, hardly any paired anchors; neighbours that agree by chance excepted
    assert spans.runs.count() < 300 * 299 // 100
    assert 300 * 155 <= spans.windows.count() <= 300 * 170
    assert spans.cliques.count() <= 300 * 12
    assert sp.linked_classes(spans).count() == 300 * 299 // 2
    assert all(r["n_shared"] >= 400 for r in sp.shared_shares(spans).collect())


def test_windows_are_hashed_alike_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(sp, "PIECE", 64)
    monkeypatch.setattr(sp, "_powers", lambda base, seed, n, f=sp._powers: f(base, seed, n, {}))
    data = np.frombuffer(random.Random(3).randbytes(300) * 2, np.uint8)
    at = np.arange(0, 200)
    for which in (0, 1):
        one = sp.window_hashes(data, at, at + 90, which)
        assert (one == sp.window_hashes(data, at + 300, at + 390, which)).all() and len(set(one.tolist())) == 200


def test_texts_that_agree_in_one_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(sp, "hash_pair", lambda c: (F.length(c).cast("bigint"), F.xxhash64(c)))
    rows = [(1, "a" * 300), (2, "b" * 300), (3, "a" * 300), (4, "c" * 300), (5, "x" + "c" * 299)]
    assert run(spark, rows) == ([(1, 3), (4, 5)], {1: 300, 2: 0, 3: 300, 4: 300, 5: 299})
