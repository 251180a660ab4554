"""Phrases by dynamic counting against plain counts."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from hazardgrid.llm import collocations, queries


def corpus():
    rng = random.Random(8)
    words = ["a", "B", "cé", "dd", "𝄞", "f-g", "H"]
    rows = []
    for k in range(120):
        text = []
        for _ in range(rng.randrange(60)):
            text.append(rng.choice(["of the big house", "Of  the", rng.choice(words), rng.choice(words) + rng.choice(".,;:!?\n\x0b \t")]))
        rows.append((k % 90, " ".join(text), rng.choice(["en", "de", None])))
    return rows + [(500, None, "en"), (501, "", "xx"), (None, "a b. a b", "en"), (502, "...", None), (503, "x " * 3000, "en")]


def plain(rows):
    f = collections.Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", k, " ".join(w[i : i + k])] += 1
    return f


@pytest.mark.parametrize("bits, shards", [(14, 3), (3, 2)])  # with 8 slots nearly everything starts early
def test_counts_equal_plain_counts(spark, monkeypatch, bits, shards):
    monkeypatch.setattr(collocations, "STRETCH", 50)
    rows = corpus()
    want = plain(rows)
    docs = spark.createDataFrame([(*r, 3, "p") for r in rows], "doc_id long, text string, lang string, k int, phrase string")
    got = {(r.lang, r.k, r.phrase): r.c for r in collocations.count_phrases(docs, 30, shards, bits).collect()}
    assert {k: v for k, v in got.items() if k[1]} == {k: v for k, v in want.items() if v >= 30}
    assert max(k for _, k, _ in got) == 4
    n = collections.Counter()
    for (lang, k, _), v in want.items():
        n[lang] += v * (k == 1)
    assert {k[0]: v for k, v in got.items() if k[1] == 0 and v} == {k: v for k, v in n.items() if v}


def test_query_equals_its_sql(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_dynamic_phrases(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.execute(queries.CHECK_SQL["op12_dynamic_phrases"])
    at = [[d[0] for d in rel.description].index(c) for c in got.columns]
    have = sorted(map(tuple, got.collect()))
    assert have == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    assert len({r[0] for r in have}) > 1 and len(have) > 10


def test_a_phrase_is_counted_from_its_start_for_one_cycle():
    first = np.array([5, 6, 7, 0, 8], np.int32)
    reached = [np.full(1 << 10, collocations.NEVER, np.uint8) for _ in range(4)]
    seen = lambda: [[len(x) for _, x in collocations.active_slots(first, reached, s, 4)] for s in range(8)]
    assert seen() == [[4, 0, 0, 0]] * 4 + [[0, 0, 0, 0]] * 4
    reached[0][[5, 6]], reached[0][7] = 1, 3
    assert [x[1] for x in seen()] == [0, 1, 1, 2, 2, 1, 1, 0]  # one pair starts in scan 1, the other in scan 3


def test_no_documents(spark):
    assert collocations.top_phrases(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
