"""What repeats on a host's pages decides inside their root elements, too, and copies of pages do not count."""

from hazardgrid.llm import html


def texts(spark, rows):
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in got}


def test_repeated_blocks_inside_the_root_go(spark):
    page = "<body><article><div class='claim'>Daily news of the town</div><p>story {0}</p><p><a href='/'>source {0}</a></p></article></body>"
    got = texts(spark, [(k, f"http://h/{k}", page.format(k)) for k in range(8)])
    assert got == {k: f"story {k}\n\nsource {k}" for k in range(8)}


def test_copies_of_pages_are_no_template(spark):
    rows = [(k, f"http://three/{k}", "<p>alone</p>") for k in range(3)]
    for host, page in (("plain", "<div><p>{}</p><p>and more</p></div>"), ("root", "<nav>{0}</nav><main><p>{0}</p></main>")):
        at = len(rows)
        rows += [(at + k, f"http://{host}/{k}", page.format("the copied one")) for k in range(6)]
        rows += [(at + 6 + k, f"http://{host}/{6 + k}", page.format(f"story {k}")) for k in range(6)]
    got = texts(spark, rows)
    assert [got[k] for k in range(3)] == ["alone"] * 3
    assert got[3] == "the copied one\n\nand more" and got[9] == "story 0\n\nand more"
    assert got[15] == "the copied one" and got[26] == "story 5"
