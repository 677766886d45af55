import random

from helpers import connect, difference, folder_tables

from eventbook.llm import warc

SQL = warc.ORACLE.format(pages="pages")
SCHEMA = "page_id long, url string, html string, place long"


def check(pages):
    got = warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_no")
    assert difference(got, connect(pages=pages), SQL) is None


def test_odd_rows(spark):
    same = "<p>" + "é" * 60 + "</p>"
    rows = [(i, f"http://www.Site.example:80/{i % 3}?q#f", same) for i in range(1, 40)]
    rows += [(100, None, None), (101, None, ""), (None, "no url", "x" * 200), (None, "no url", "x" * 200), (102, "a\r\nb", "WARC/1.1\r\n\r\n"), (103, "http://h", same[:20])]
    rows += [(104, "https://u@h:443", same[:20]), (1, "http://www.Site.example:80/1?q#f", same), (105, "ftp://x.y/z", "line\r\n\r\nWARC/1.1 " * 30000)]
    check(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA))


def test_given_table(spark):
    check(folder_tables(spark, "pages")["pages"])


def test_ranges_of_a_much_captured_url(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    pages = spark.createDataFrame([(i, "http://h/a" if i % 3 else f"http://h/{i}", f"page {i}", 1) for i in range(400)], SCHEMA)
    check(pages)
    order = [(r["url_key"], r["captured_at"]) for r in warc.archive(pages).orderBy("range_no").collect()]
    assert len(order) == 400


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_loser_tree_merges():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rnd.choices(range(50), k=rnd.randint(0, 20))) for _ in range(k)]
        got = list(warc.LoserTree([[(x,) for x in r] for r in runs], key=lambda t: t))
        assert got == sorted((x,) for r in runs for x in r)
