"""Lines, counts, rules, quality, toxicity and mixing against brute force, and their defined edge results."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardgrid.llm import lines, mixing, quality, queries, rules, simhash, textstats, toxic
from hazardgrid.llm.common import components
from tests.conftest import FOLDER


def frame(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame(rows, names)


def test_line_classes_equal_the_check_sql_with_a_hot_group(spark, monkeypatch, tmp_path):
    rng = random.Random(4)
    base = "the quick brown fox jumps over the lazy dog é again"
    docs = [(k, base[:p] + rng.choice("xyzQ") + base[p + rng.choice((0, 1)) :]) for k, p in enumerate(rng.choices(range(len(base)), k=160))]
    docs += [(200 + k, base[:7] + chr(97 + k % 26) + chr(97 + k // 26) + base[9:]) for k in range(120)]
    docs += [(400, base), (401, base + "\n" + base), (402, ""), (403, " \t \n\x0b"), (404, "short\nshart"), (405, base[:-1]), (406, "z" + base)]
    docs += [(500 + k, "".join(rng.choice("ab") for _ in range(24))) for k in range(60)]
    monkeypatch.setattr(lines, "HOT", 6)
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_line_edit_join(spark, str(tmp_path))
    names = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.CHECK_SQL["op2_line_edit_join"]).df()[names]
    have = sorted(tuple(r[n] for n in names) for r in got.collect())
    assert have == sorted(map(tuple, want.astype(object).values.tolist()))
    assert max(r[names.index("n_links")] for r in have) > 20


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bit_parallel_distance(spark):
    rng = random.Random(2)
    pairs = [("", ""), ("a", ""), ("", "b"), ("ab", ""), ("é", "e")]
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(8)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "é"])
        pairs.append((a, "".join(b)))
    got = frame(spark, pairs, "a string, b string").select("a", "b", lines.within_one_edit(F.col("a"), F.col("b")).alias("x"))
    for r in got.collect():
        assert r.x == (plain_distance(r.a, r.b) <= 1), r


def test_repeated_lines_go_and_clean_ones_stay(spark):
    passage = "a passage of many words that several documents share word by word"
    docs = [
        (1, f"own first line here\n{passage}\n\nthe end of one", "a", 0), (2, f"{passage}\nanother own line", "b", 0),
        (3, passage.replace("word by", "ward by") + "\nthird own line", "c", 0), (4, passage, "d", 0), (5, None, "e", 0), (6, "", "f", 0),
        (7, "clean one\nclean two", "g", 0), (7, "clean one\nclean two", "g", 0), (8, "x\nx", "h", 0), (8, "other text of the same id", "h", 0),
        (None, "text without id", "i", 0),
    ]
    out = lines.drop_repeated_lines(frame(spark, docs, "doc_id long, text string, pos string, n_chars long"))
    assert out.columns == ["doc_id", "text", "pos", "n_chars"]
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr)
    want = [
        (1, f"own first line here\n{passage}\n\nthe end of one"), (2, "another own line"), (3, "third own line"), (5, None), (6, ""),
        (7, "clean one\nclean two"), (7, "clean one\nclean two"), (8, "x"), (8, "other text of the same id"), (None, "text without id"),
    ]
    assert got == sorted(((d, t, None if t is None else len(t)) for d, t in want), key=repr)
    assert lines.drop_repeated_lines(frame(spark, [])).count() == 0


def test_columns_with_clashing_names_are_kept(spark):
    extra = ["_id", "_print", "_gone", "_w", "_t", "row", "line", "pos", "label", "fp", "score", "rate", "a.b"]
    rng = random.Random(1)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(9))
    docs = frame(spark, [(k, f"{line()}\nshared line of all the documents", *range(len(extra))) for k in range(6)],
                 "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in extra))
    labels = frame(spark, [(1, 1, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    stages = [
        lambda d: quality.keep_good(d, labels), lines.drop_repeated_lines, lambda d: simhash.keep_one_per_component(d, simhash.near_copies(d)),
        lambda d: mixing.keep_by_rate(d, queries.domains_of(labels), {"clean": 1.0}),
    ]
    for stage in stages:
        out = stage(docs)
        assert out.columns == docs.columns and out.count() >= 5
        assert all(tuple(r)[2:] == tuple(range(len(extra))) for r in out.collect())


def test_components_by_force(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(90)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.label for r in components(frame(spark, edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def plain_counts(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    ls = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(covered)


TEXTS = [
    None, "", " \n\t", "a b a b a b a", "one two three four\none two three four\n\none two three five six", "x" * 5000, "\x1ca b\x85c d",
    "w " * 20000, "# * $ % & | < > é É ß", " lead\x0band\x0ctrail \r\n", "a b c\r\na b c\r\na b c",
]


def test_counts_by_force(spark):
    real = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    texts = TEXTS + real
    out = textstats.with_counts(frame(spark, list(enumerate(texts))), repeats=True)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain_counts(t), repr((t or "")[:40])


def test_rules_query(spark):
    got = queries.op8_decision_list_rules(spark, "/root/testdata/sf0.01").collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.rule is None)
    seen = [(label[r.doc_id], r.kept) for r in got if r.doc_id in label and not r.base_failed]
    assert np.mean([k for y, k in seen if y == 1]) > 0.97 and np.mean([k for y, k in seen if y == 0]) < 0.2


def test_rules_without_labels_keep_what_passes(spark):
    docs = frame(spark, [(1, " ".join(f"w{k}" for k in range(60))), (2, None), (None, "a")])
    out, found = rules.judge(docs, frame(spark, [], "doc_id long, quality int, toxic int"))
    assert found.rules == [] and sorted(r.kept for r in out.collect()) == [False, False, True]
    assert rules.judge(frame(spark, []), frame(spark, [(1, 1, 0)], "doc_id long, quality int, toxic int"))[0].count() == 0


def auc(label, score):
    a, b = ([s for y, s in zip(label, score) if y == k] for k in (1, 0))
    return np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b])


@pytest.mark.parametrize("name, column, part, of", [("op9_toxic_segments", "toxic", 1, 3), ("op10_pu_quality", "quality", 2, 4)])
def test_held_out_accuracy(spark, name, column, part, of):
    folder = "/root/testdata/sf0.1" if column == "toxic" else "/root/testdata/sf0.01"
    label = {r.doc_id: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == part) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    test = [(label[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in label]
    assert auc([t[0] for t in test], [t[1] for t in test]) > 0.93
    assert np.mean([t[0] == t[2] for t in test]) > 0.93


def test_quality_and_toxicity_edges(spark):
    labels = "doc_id long, quality int, toxic int"
    docs = frame(spark, [(1, None), (2, ""), (None, "a b"), (1, "x y")])
    scored, _ = quality.classify(docs, frame(spark, [], labels))
    assert [r.score for r in scored.collect()] == [1.0] * 4
    assert [r.score for r in toxic.score(docs, frame(spark, [(1, 1, 1)], labels)).collect()] == [0.0] * 4
    assert toxic.score(frame(spark, []), frame(spark, [(1, 1, 1), (2, 0, 0)], labels)).count() == 0
    some = [(k, "good words here number " + str(k)) for k in range(30)] + [(99, None), (98, "")]
    some += [(100 + k, "you scum scum idiot go away " + str(k)) for k in range(30)]
    marks = frame(spark, [(k, 1, 0) for k in range(30)] + [(100 + k, 1, 1) for k in range(30)] + [(99, None, None)], labels)
    got = {r.doc_id: r for r in toxic.score(frame(spark, some).withColumn("score", F.lit(1)), marks).collect()}
    assert got[3].score < 0.3 and got[105].score > 0.7 and got[99].score < 0.5 and got[98].score < 0.5
    kept = quality.keep_good(frame(spark, [(*s, 1) for s in some], "doc_id long, text string, score int"), marks)
    assert kept.columns == ["doc_id", "text", "score"] and kept.filter("doc_id < 30").count() == 30


def plain_segments(x):
    """Recursive definition: the best segment, then the best of what lies left and right of it."""
    sums = np.concatenate(([0.0], np.cumsum(x)))
    best = max(((sums[j] - sums[i], i - j, -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=None)
    if best is None or best[0] <= 1e-12:
        return []
    _, _, _, i, j = best
    left, right = plain_segments(x[:i]), plain_segments(x[j:])
    return left + [(i, j)] + [(a + j, b + j) for a, b in right]


def test_maximal_segments_by_force():
    rng = random.Random(6)
    for _ in range(300):
        x = [rng.choice((-3.1, -1.7, -0.4, 1.3, 2.2, 5.9)) + rng.random() / 7 for _ in range(rng.randrange(14))]
        assert [(a, b) for a, b, _ in toxic.maximal_segments(x)] == plain_segments(x)
    assert toxic.scan([-0.1] * 5 + [4.0, -0.1, 4.0] + [-0.1] * 9, -0.1) == [(5, 8, pytest.approx(7.9))]


def test_rates_by_force(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 80)
    w = rng.integers(0, 50, 80)
    rows = [(k, int(w[k]), *map(float, p[k])) for k in range(80)]
    soft = spark.createDataFrame(rows, "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    target = np.array([0.5, 0.3, 0.2])
    rate = np.ones(80)
    total = (w * rate) @ p
    goal = target * total[0] / target[0]
    for most in (None, 1.0):
        got = {r.doc_id: r.rate for r in mixing.fit_rates(soft, list(target), most).collect()}
        have = sum(w[k] * got[k] * p[k] for k in got)
        assert min(got.values()) >= 0
        if most is None:
            assert np.allclose(have, goal, rtol=2e-3)
        else:
            r = np.ones(80)
            for _ in range(4000):
                r = np.clip(r - p @ (((w * r) @ p - goal) / total), 0, 1)
            best = (((w * r) @ p - goal) / total) @ (((w * r) @ p - goal) / total)
            now = ((have - goal) / total) @ ((have - goal) / total)
            assert max(got.values()) <= 1 and now <= 1.2 * best + 1e-3


def test_mixing_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c")])
    out = mixing.mix(docs, frame(spark, [(3, "x"), (3, None), (None, "y")], "doc_id long, domain string"), {"x": 1, "y": 1}).collect()
    assert len(out) == 5 and all(abs(r.p_x + r.p_y - 1) < 1e-9 and r.rate >= 0 for r in out)
    assert sorted(r.n_tokens for r in out) == [0, 0, 1, 2, 2]
    assert mixing.mix(frame(spark, []), frame(spark, [], "doc_id long, domain string"), {"x": 1, "y": 1}).count() == 0
    draws = spark.range(4000).select(mixing.copies(F.lit(1.25), "id").alias("c")).agg(F.avg("c")).first()[0]
    assert abs(draws - 1.25) < 0.03
