"""Tensored MinHash against the Jaccard similarity of all pairs."""

import random
import re

import numpy as np

from hazardgrid.llm import tensored


def slow_set(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def by_force(rows):
    sets, root, near = [slow_set(t) for _, t in rows], list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
                near += a != b
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = [(d, len(sets[i]), least.get(find(i)), d is not None and d == least.get(find(i))) for i, (d, _) in enumerate(rows)]
    return sorted(out, key=repr), near


def planted(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows, passage = [], [word() for _ in range(60)]
    for k in range(40):
        text = [word() for _ in range(rng.choice((1, 2, 3, 12, 60, 150)))] + passage * (k % 3 == 0)
        rows.append((len(rows), " ".join(text)))
        for _ in range(3):  # runs of changed words: similarities on both sides of the threshold
            copy = list(text)
            at, n = rng.randrange(len(copy)), max(1, len(copy) // rng.choice((8, 12, 16, 20, 40)))
            copy[at : at + n] = [word() for _ in copy[at : at + n]]
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy)))
    base = [word() for _ in range(120)]
    for _ in range(60):  # a group around its origin: members link to it, not always to each other
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(120)] = word()
        rows.append((len(rows), " ".join(copy)))
    rows.append((len(rows), " ".join(base)))
    for _ in range(60):  # most of a text in common, but no link
        rows.append((len(rows), " ".join(passage + [word() for _ in range(rng.randrange(14, 20))])))
    step = list(base)
    for _ in range(30):  # a chain
        at = rng.randrange(118)
        step = step[:at] + [word(), word()] + step[at + 2 :]
        rows.append((len(rows), " ".join(step)))
    return rows + [(900, None), (901, " \n "), (None, "a b"), (None, "x y z"), (902, "A  b"), (5, rows[7][1]), (903, "Àb c"), (901, "\t")]


def test_components_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(tensored, "MEMBERS", 16)
    rows = planted()
    want, near = by_force(rows)
    assert near > 300
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, key string")
    assert sorted(map(tuple, tensored.near_copies(docs).collect()), key=repr) == want


def test_minhash_groups_meet_as_often_as_they_should():
    rng = np.random.default_rng(1)
    hits = []
    for _ in range(300):
        a = rng.integers(0, 2**63, 200).astype(np.uint64)
        b = np.concatenate((a[:180], rng.integers(0, 2**63, 20).astype(np.uint64)))  # similarity 180 / 220
        hits.append((tensored.groups(np.unique(a)) == tensored.groups(np.unique(b))).mean())
    assert abs(np.mean(hits) - (180 / 220) ** tensored.WIDTH) < 0.03


def test_merges_connect_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    base = np.arange(100)
    sets = [np.sort(np.concatenate((rng.permutation(base)[:94], 1000 * (k + 1) + np.arange(rng.integers(1, 9))))) for k in range(60)]
    label = rng.integers(0, 50, 60)
    root = label.copy()
    for i in range(60):
        for j in range(i):
            x = np.intersect1d(sets[i], sets[j]).size
            if 100 * x >= 85 * (len(sets[i]) + len(sets[j]) - x):
                root[root == root[i]] = root[j]
    halves = np.arange(30), np.arange(30, 60)
    got = label.copy()
    for left, right in (halves, (halves[0], halves[0]), (halves[1], halves[1])):
        found = tensored.merges(sets, label, left, right)
        assert len(found) < 60
        for i, j in found:
            got[got == got[i]] = got[j]
    assert len(np.unique(root)) == len(np.unique(got)) == len(np.unique(root * 100 + got)) > 1


def test_no_documents_and_one_very_long_one(spark):
    assert tensored.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(0)
    text = " ".join(str(rng.random()) for _ in range(120_000))
    got = tensored.near_copies(spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 119_998, 1, True), (2, 119_999, 1, False)]
