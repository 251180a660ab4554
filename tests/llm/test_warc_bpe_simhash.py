"""WARC against a plain parser, the codec against the reference library, fingerprints by brute force."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from hazardgrid.llm import bpe, queries, simhash, warc
from tests.conftest import FOLDER

EVIL = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\ncut"
ROWS = [
    (1, "http://a/WARC/1.0", EVIL), (2, "http://a/\r\nX: 1", EVIL), (3, None, None), (None, "u", ""), (4, "u", "é" * 700),
    (5, "u", "é" * 700), (5, "u", "é" * 700), (6, "u", "end\r\n"), (7, "u", "\r\n\r\n\r\n"), (8, "u", "y" * 5000 + EVIL),
]


def parse(data: bytes) -> list[bytes]:
    """Payloads by walking from the file's start."""
    out, at = [], 0
    while data[at : at + 7] == b"WARC/1.":
        stop = data.index(b"\r\n\r\n", at)
        n = next(int(x.split(b":")[1]) for x in data[at:stop].split(b"\r\n") if x.lower().startswith(b"content-length"))
        out.append(data[stop + 4 : stop + 4 + n])
        at = stop + 8 + n
    return out


@pytest.mark.parametrize("split", ["64", "333", "134217728"])
def test_records_survive_magic_in_payloads_at_any_split(spark, tmp_path, split):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(2)
    warc.write_archives(warc.assign_revisits(pages), str(tmp_path / "a"))
    data = [p.read_bytes() for p in sorted((tmp_path / "a").glob("part-*"))]
    want = sorted(x for d in data for x in parse(d))
    assert len(want) == len(ROWS)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rec = warc.read_archives(spark, str(tmp_path / "a")).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sorted(bytes(r.payload) for r in rec) == want
    assert not any(r.truncated for r in rec)
    types = sorted((r.record_id or "", r.record_type, r.refers_to or "") for r in rec if r.record_type == "revisit")
    assert types == [("<urn:page:4>", "revisit", "<urn:page:5>")]


def test_truncated_foreign_and_empty_archives(spark, tmp_path):
    one = "WARC/1.1\r\ncontent-length: 5\r\nWARC-Type: Response\r\n\r\n"
    (tmp_path / "b").mkdir()
    (tmp_path / "b/1.warc").write_bytes((one + "abcde\r\n\r\n" + one + "ab").encode())
    (tmp_path / "b/2.warc").write_bytes(b"no archive\r\n\r\n" + (one + "abcde\r\n\r\n").encode())
    got = sorted((bytes(r.payload), r.truncated, r.record_type) for r in warc.read_archives(spark, str(tmp_path / "b")).collect())
    assert got == [(b"ab", True, "response"), (b"abcde", False, "response")]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.assign_revisits(none), str(tmp_path / "c"))
    assert warc.read_archives(spark, str(tmp_path / "c")).count() == 0


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_library(encoding):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.Codec(bpe.serialise_model(bpe.read_ranks(path)), public_tokenizers.PATTERN)
    rng = random.Random(1)
    alphabet = "abcTHE théß日本 \n\t\r  '  \x1c\x85\x00▁Ġ😀é123!?-_<unk>"
    texts = ["", " ", "<unk>", "a" * 3000, " \n \n x", "it's we'll I'D", "▁a", "日本語テキスト"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    for t in texts:
        packed = codec.encode(t)
        assert bpe.unpack_ids(packed) == encoding.encode_ordinary(t), repr(t)
        assert codec.decode(packed) == t.encode()


def test_round_trip_query(spark, encoding):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries.op6_bpe_round_trip(spark, FOLDER).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def slow_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_force(rows):
    prints = [(d, slow_print(t)) for d, t in rows]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)), key=repr)


def test_fingerprints_and_components(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 40)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs] + [(900, None), (901, " \n "), (902, "ÀB c"), (None, "Àb C"), (903, "a\x1cb c d e"), (5, docs[0].text)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_simhash_vantage_trees(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_force(rows)


def test_trees_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 30)
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), k)) for s in seeds for k in range(7) for _ in range(6)}
    prints |= {0xAAAA << 48 | rng.getrandbits(48) for _ in range(300)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    label = {r.node: r.label for r in simhash.components(edges).collect()}
    for (a,) in signed:
        for (b,) in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert label[a] == label[b]
    for r in edges.collect():
        assert ((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 60


def test_empty_documents_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op3_simhash_vantage_trees(spark, str(tmp_path)).count() == 0
    assert queries.op6_bpe_round_trip(spark, str(tmp_path)).count() == 0
