"""Neighbours by brute force, page texts by hand, the pipeline against the operators' decisions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hazardgrid.llm import ann, html, queries, simhash
from tests.conftest import FOLDER


def by_force(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 50 == 0:
            s = [(-(v @ u) / math.sqrt((v @ v) * (u @ u)), j) for j, u in ok if j != i]
            out[i] = sorted(s)[:k]
    return out


def test_neighbours_recall_scores_and_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 128)
    real = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    d = len(real[0][1])
    hot = [0.5] * d
    bad = [(10_000, None), (10_050, []), (10_100, [0.0] * d), (10_150, [math.nan] * d), (10_200, [None] * d), (10_250, [math.inf] * d)]
    same = [(20_000 + k, hot) for k in range(120)]
    rows = real + bad + same + [(30_000, [1.0]), (None, hot)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("name", F.lit(0)).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in queries.op4_ann_projected_kdtree(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = by_force(real + same, 5)
    assert set(got) == set(want)
    hit = sum(len({x[1] for x in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == [1, 2, 3, 4, 5] and all(x[1] != q for x in found)
        assert [(-x[2], x[1]) for x in found] == sorted((-x[2], x[1]) for x in found)
    assert [x[1] for x in got[20_000]] == [20_001, 20_002, 20_003, 20_004, 20_005]


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post"><header><h1>Caf&eacute;  &amp;\n tea</h1></header><p>One <b>bold<i> x</b> y<br>z<p>Two &lt;3 <script>var a="</p>";</script>end
<aside>side</aside><form><label>Name</label><input></form><div class="ad">Buy</div><ul><li>first<li>second</ul>
<section id="comments"><p>Nice!</p></section><footer>by me</footer></article><footer>&copy; us</footer></body></html>"""


def test_article_page():
    want = "Café & tea\n\nOne bold x y z\n\nTwo <3 end\n\nfirst\n\nsecond"
    assert html.main_text(PAGE, None, frozenset()) == want
    assert html.main_text("<nav>menu<article><p>Left open before it</p>", None, frozenset()) == "Left open before it"
    assert html.main_text(None, None, frozenset()) == "" and html.main_text("<p>cut <b", None, frozenset()) == "cut"


def test_template_of_a_host_is_learned(spark):
    page = "<html><body><div class='top-line'>Daily News of the Town</div><div class='cell'><p>{}</p><p>more {}</p></div><div class='end'>All rights reserved</div></body></html>"
    rows = [(k, f"http://H.example/{k}", page.format(f"story {k}", f"of day {k}")) for k in range(12)]
    rows += [(20, "http://h.example/z", page.format("story z", "of z").replace("<div class='cell'>", "<div class='new'>New box</div><div class='cell'>"))]
    rows += [(30, None, None), (31, "http://one.example/", "<p>alone</p>"), (31, "http://one.example/", "<p>alone</p>")]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    text = {}
    for r in got.collect():
        text.setdefault(r.page_id, []).append(r.text)
    assert text[3] == ["story 3\n\nmore of day 3"] and text[20] == ["New box\n\nstory z\n\nmore of z"]
    assert text[30] == [""] and text[31] == ["alone", "alone"]
    assert html.extract_main_text(got.select("page_id", "url", F.col("text").alias("html")).limit(0)).count() == 0


def test_tree_matching_by_force():
    rng = random.Random(3)

    def grow(depth):
        return {k: grow(depth - 1) for k in rng.sample("abcde", rng.randrange(4))} if depth else {}

    def plain(a, b):
        if not a or not b:
            return 0
        (x, xa), *ra = a.items()
        (y, yb), *rb = b.items()
        best = max(plain(dict(ra), b), plain(a, dict(rb)))
        return max(best, 1 + plain(xa, yb) + plain(dict(ra), dict(rb))) if x == y else best

    for _ in range(200):
        a, b = grow(3), grow(3)
        size, pairs = html.match_trees(a, b)
        assert size == plain(a, b)
        assert html.read_structure(html.written(a)) == a


def test_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "mix_to_targets", "bpe_encode"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        if name != "bpe_encode":
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
    label = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    first = kept["quality_classifier"]
    assert np.mean([d in first for d, r in label.items() if r.quality == 1]) > 0.95
    seen = set()
    for r in sorted(kept["line_dedup"].values(), key=lambda r: r.doc_id):
        own = {x for x in r.text.split("\n") if x.strip()}
        assert not own & seen
        seen |= own
    prints = [simhash.fingerprint(r.text) & (1 << 64) - 1 for r in kept["simhash_near_dedup"].values()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    clean = [d for d in kept["simhash_near_dedup"] if d in label and label[d].quality == 1 and label[d].toxic == 0]
    assert np.mean([d in kept["mix_to_targets"] for d in clean]) > 0.95
    assert all(r.round_trip for r in kept["bpe_encode"].values())


def test_pipeline_edges(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", None, "s", 5), (3, "a b c", None, "s", 5), (None, "d e f", "en", None, 5)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    for case, data in (("some", rows), ("none", [])):
        at = str(tmp_path / case)
        spark.createDataFrame(data, names).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        assert len(got) <= 4 and {r.doc_id for r in got} <= {r[0] for r in data}
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, at)
        assert sorted((r.doc_id for r in docs.collect()), key=repr) == ([1, 3, None] if data else [])


@pytest.mark.parametrize("name", sorted(queries.CHECK_SQL))
def test_check_sql(spark, name):
    import check

    want = check.duck(FOLDER).execute(queries.CHECK_SQL[name])
    cols = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, want.fetchall()))
