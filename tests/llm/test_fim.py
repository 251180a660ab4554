"""Fill-in-middle against a plain string version and an exact round trip."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from hazardgrid.llm import fim, queries


def plain_version(text, doc_id):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", text, None, None
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if h4 % 100 < 50:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def texts():
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("ab\n\ré€𝄞 <>PSM") for _ in range(rng.randrange(60)))) for k in range(300)]
    rows += [(400, None), (401, ""), (402, "\n"), (403, "\n\n\n"), (404, "no end"), (405, "a<P>b"), (406, "<M"), (None, "a\nb\nc\n"), (400, None)]
    return rows + [(500 + k, ("long line %d é\n" % k) * 30_000) for k in range(3)] + [(503, "x" * 400_000)]


def test_equal_to_the_plain_version_and_restored(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, output string")
    made = fim.fill_in_middle(docs)
    got = made.select("*", fim.restored(made.output, made.form).alias("back")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((d, *plain_version(t, d), t or "") for d, t in rows), key=repr)


def test_query_equals_its_sql(spark, tmp_path):
    spark.createDataFrame(texts(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.execute(queries.CHECK_SQL["op13_fill_in_middle"])
    at = [[d[0] for d in rel.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_rotation(monkeypatch, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    for n in range(9):
        for a in range(n + 1):
            for m in range(a, n + 1):
                for b in range(m, n + 1):
                    buf = np.arange(n, dtype=np.uint8)
                    fim.exchange(buf, a, m, b)
                    assert buf.tolist() == [*range(a), *range(m, b), *range(a, m), *range(b, n)]


def test_no_documents(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
