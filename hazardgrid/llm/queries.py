"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardgrid.llm import ann, bpe, collocations, fim, html, lines, mixing, quality, rules, simhash, tensored, toxic, warc
from hazardgrid.llm.common import table
from hazardgrid.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_warc_boundary_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Write a record per page, read the archives back by their verified boundary chains."""
    at = work_path(spark, "warc")
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    warc.write_archives(warc.assign_revisits(pages), at, compression="gzip")
    rec = warc.read_archives(spark, at)
    own = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    again = F.col("record_type") == "revisit"
    return rec.select(
        own("record_id").alias("page_id"),
        F.when(again, F.col("stated_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, F.substring_index("content_digest", ":", -1)).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type", own("refers_to").alias("refers_to"),
    )


CHECK_SQL["op1_warc_boundary_chain"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
lead AS (SELECT digest, max(page_id) AS lead FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN lead <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN lead <> page_id THEN lead END AS refers_to
FROM d LEFT JOIN lead ON d.digest = lead.digest AND n >= 1000"""


@_query
def op3_simhash_vantage_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_copies(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op6_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every whole text, decode the ids again, and digest both."""
    tok = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), tok)
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op4_ann_projected_kdtree(spark: SparkSession, folder: str) -> DataFrame:
    """Five nearest by cosine of every vector whose id is divisible by 50, against all others."""
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_query
def op7_html_wrapper_induction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = html.extract_main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op8_decision_list_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the learned list's verdict on every document."""
    found, _ = rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept"
    )


@_query
def op9_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; every third crc32 remainder is held out of training."""
    out = quality.held_out(1, 3)
    found = toxic.score(table(spark, folder, "documents"), table(spark, folder, "labels"), ~out)
    return found.select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= toxic.THRESHOLD).cast("int").alias("predicted"), "n_passages"
    )


@_query
def op10_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; every fourth crc32 remainder is held out of training."""
    out = quality.held_out(2, 4)
    found, _ = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), ~out)
    return found.select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@_query
def op2_line_edit_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every different line with its class of near-equal lines and its number of links."""
    found = lines.line_classes(table(spark, folder, "documents"))
    return found.select(
        F.lower(F.hex("name")).alias("line_md5"), F.col("n").alias("n_chars"), "n_rows",
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.pos").alias("first_pos"),
        F.lower(F.hex("class")).alias("class_md5"), "n_links",
    )


CHECK_SQL["op2_line_edit_join"] = """
WITH RECURSIVE split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos FROM split),
d AS (SELECT md5(line) AS name, any_value(line) AS line, CAST(length(any_value(line)) AS INTEGER) AS n, count(*) AS n_rows,
             min(doc_id) AS first_doc_id, CAST(arg_min(pos, doc_id * 1000000000 + pos) AS INTEGER) AS first_pos
      FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY md5(line)),
place AS (SELECT name, line, n, unnest(range(n)) AS p FROM d WHERE n >= 20),
spare AS (SELECT name, n, p, left(line, p) AS head, substr(line, p + 2) AS tail FROM place),
rest AS (SELECT name, n, p, md5(head || chr(10) || tail) AS k, md5(head || tail) AS shorter FROM spare),
link AS (SELECT a.name AS a, b.name AS b FROM rest a JOIN rest b ON a.n = b.n AND a.p = b.p AND a.k = b.k AND a.name <> b.name
         UNION SELECT r.name, d.name FROM rest r JOIN d ON r.shorter = d.name AND d.n >= 20
         UNION SELECT d.name, r.name FROM rest r JOIN d ON r.shorter = d.name AND d.n >= 20),
reach AS (SELECT name, name AS other FROM d UNION SELECT reach.name, link.b FROM reach JOIN link ON link.a = reach.other),
class AS (SELECT name, min(other) AS class FROM reach GROUP BY name),
degree AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT d.name AS line_md5, n AS n_chars, n_rows, first_doc_id, first_pos, class AS class_md5, coalesce(n_links, 0) AS n_links
FROM d JOIN class ON class.name = d.name LEFT JOIN degree ON degree.a = d.name"""

#: Domains of the mix, as the labels name them, and the wanted shares of the tokens.
TARGETS = {"clean": 0.90, "junk": 0.05, "toxic": 0.05}


def domains_of(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: junk for low quality, else toxic or clean."""
    name = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", name.alias("domain"))


@_query
def op5_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Memberships, rate and drawn copies of every document."""
    found = mixing.mix(table(spark, folder, "documents"), domains_of(table(spark, folder, "labels")), TARGETS)
    return found.withColumn("copies", mixing.copies(F.col("rate"), "doc_id"))


@_query
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Form and digests of every document's transformation and of the text rebuilt from it."""
    made = fim.fill_in_middle(table(spark, folder, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


CHECK_SQL["op13_fill_in_middle"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units,
             ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
             least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT doc_id, text, n, form, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle,
             array_to_string(units[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s"""


@_query
def op11_minhash_tensored(spark: SparkSession, folder: str) -> DataFrame:
    """Set size, component and verdict of every document."""
    return tensored.near_copies(table(spark, folder, "documents"))


@_query
def op12_dynamic_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Best phrases of every language."""
    found = collocations.top_phrases(table(spark, folder, "documents"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


CHECK_SQL["op12_dynamic_phrases"] = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3), (4)) AS lengths(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cut AS (SELECT c.*, unnest(range(1, k)) AS pos FROM c),
s AS (SELECT cut.lang, cut.phrase, cut.k, cut.a, cut.w, pos, l.a AS l, r.a AS r,
             CAST(CAST(cut.a AS HUGEINT) * 2000000 // (l.a + r.a) AS BIGINT) AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(cut.w[1 : pos], ' ')
               JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(cut.w[pos + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
piece AS (SELECT lang, a, w, size, unnest(range(1, k - size + 2)) AS i FROM c, (VALUES (2), (3)) AS sizes(size) WHERE size < k),
o AS (SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(a) AS over FROM piece GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE over IS NULL OR 100 * over < 80 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000"""
