import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talefold.llm import neardup as N


def brute(rows, t=0.6, least=20):
    sets = []
    for row_id, title, text in rows:
        if text is None or len(body := re.findall(r"[^\W_]+", text.lower())) < least:
            continue
        w = re.findall(r"[^\W_]+", (title or "").lower()) + body
        sets.append((row_id, {tuple(w[i : i + 3]) for i in range(len(w) - 2)}))
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a != b and len(x & y) >= t * len(x | y) - 1e-12:
                out.add((min(a, b), max(a, b)))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(r.choice([30, 400]))]
    rows, texts = [], []
    for k in range(n):
        if texts and r.random() < 0.6:
            words = list(r.choice(texts))
            for _ in range(r.randrange(0, max(2, len(words) // 12))):
                at = r.randrange(len(words))
                if r.random() < 0.4:
                    words[at] = r.choice(vocabulary)
                elif r.random() < 0.5:
                    words.insert(at, r.choice(vocabulary))
                else:
                    del words[at]
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([5, 20, 25, 60, 150, 400]))]
        if words:
            texts.append(words)
        rows.append((k, r.choice([None, "A Title", "The Other One"]), " ".join(words)))
    return rows + [(n, None, None), (n + 1, "A", ""), (n + 2, "A Title", rows[1][2]), (n + 3, "A Title", rows[1][2])]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "row_id bigint, title string, text string")
    return df.select("row_id", "text", F.struct(F.col("title").alias("Title")).alias("metadata")).repartition(3)


@pytest.mark.parametrize("width", [0, 1, 2, 3])
def test_same_pairs_as_brute_force(spark, monkeypatch, width):
    """Also with each width of keys forced upon all size classes."""
    if width:
        monkeypatch.setattr(N, "plan_widths", lambda *a: (np.full(N.CLASSES, width), 1e5))
    rows = corpus(width)
    assert {tuple(r) for r in N.near_duplicate_pairs(frame(spark, rows)).collect()} == brute(rows)


@pytest.mark.parametrize("width", [1, 2])
def test_split_keys_and_many_ranges_give_the_same_pairs(spark, monkeypatch, width):
    """Every shared key split into groups, and keys dealt into a thousand ranges."""
    rows = corpus(width + 7)
    monkeypatch.setattr(N, "HOT", 2)
    monkeypatch.setattr(N, "KEYS_PER_TASK", 100)
    monkeypatch.setattr(N, "plan_widths", lambda *a: (np.full(N.CLASSES, width), 1e5))
    # functions that run in workers see the module as it is on disk, so the split is tested by itself as well
    assert {tuple(r) for r in N.near_duplicate_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_every_two_records_of_a_split_key_meet_once_at_least(monkeypatch):
    monkeypatch.setattr(N, "HOT", 10)
    r = np.random.default_rng(3)
    names = r.integers(-(1 << 62), 1 << 62, 95)
    key, owner = np.full(95, 12345 << 1, np.uint64), np.arange(95)
    out, who = N.split_hot(key, owner, np.full(95, 95), names)
    met, sizes = set(), []
    for k in np.unique(out):
        inside = who[out == k]
        sizes.append(len(inside))
        met |= {(int(a), int(b)) for a in inside for b in inside if a < b}
    assert len(met) == 95 * 94 // 2 and max(sizes) < 60 and len(out) == 95 * 10
    assert len(N.split_hot(key, owner, np.full(95, 5), names)[0]) == 95


def test_width_grows_with_the_frequencies():
    rare, common = np.full(1 << 20, 2, np.int32), np.full(1 << 20, 500_000, np.int32)
    few = N.plan_widths({7: (10_000, 1_500_000)}, rare, 10_000, 0.6)[0][7]
    many = N.plan_widths({7: (100_000_000, 15_000_000_000)}, common, 100_000_000, 0.6)[0][7]
    assert few == 1 and many > 1


@pytest.mark.parametrize("t", [0.5, 0.6, 0.8])
def test_prefixes_share_enough_in_any_pair(t):
    """Sets at the threshold share as many prefix shingles as the groups need."""
    r = random.Random(7)
    for _ in range(300):
        n = r.randrange(3, 400)
        m = r.randrange(n, int(n / t) + 1)
        common = -(-int(np.ceil(t / (1 + t) * (n + m) - 1e-9)) // 1)
        if common > n:
            continue
        universe = r.sample(range(10**6), n + m - common)
        x, y = set(universe[:n]), set(universe[n - common :])
        k = N.size_class(np.array([m]))
        for width in (1, 2, 3):
            w = np.array([width])
            px = int(N.prefix(np.array([n]), np.maximum(np.array([n]), N.class_bounds(k)[0]), k, w, t)[0])
            py = int(N.prefix(np.array([m]), np.ceil(t * np.array([m]) - 1e-9).astype(int), k, w, t)[0])
            shared = set(sorted(x)[:px]) & set(sorted(y)[:py])
            g = int(N.groups(k, w, t)[0])
            assert len(shared) >= (width - 1) * g + 1


def test_hot_copies_are_one_entry(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(i, None, text) for i in range(60)] + [(100, None, text + " more")]
    assert len(N.near_duplicate_pairs(frame(spark, rows)).collect()) == 61 * 60 // 2
    sets = N.similar_sets(frame(spark, rows))[1]
    assert sets.count() == 1


def test_groups(spark):
    base = [f"word{k}" for k in range(60)]
    chain = [" ".join(base[k * 4 :] + [f"x{j}" for j in range(k * 4)]) for k in range(5)]
    rows = [(i + 10, None, t) for i, t in enumerate(chain)] + [(1, None, "alone " * 30), (2, None, None), (3, None, chain[2])]
    got = {r["row_id"]: tuple(r)[1:] for r in N.near_duplicate_groups(frame(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == {10: 3, 11: 3, 12: 3, 13: 3, 14: 3, 3: 3, 1: 1, 2: 2}
    assert got[3][1] == 2 and got[1][1:] == (1, 0)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in N.components(edges).collect()}
    assert set(got[i] for i in range(201)) == {0} and got[1001] == 1000


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, None, long), (2, None, long + " end"), (3, None, "short " * 25)]
    assert {tuple(r) for r in N.near_duplicate_pairs(frame(spark, rows)).collect()} == {(1, 2)}
