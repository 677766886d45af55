from helpers import connect, difference, documents

from eventbook.llm import line_dedup

LICENSE = "Licensed under these terms."


def result(docs):
    return line_dedup.remove_spread_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def check(docs):
    sql = line_dedup.ORACLE.format(documents="documents")
    assert difference(result(docs), connect(documents=docs), sql) is None


def rows_near_threshold():
    rows, i = [], 0
    for sites in (1, 8, 9, 10, 11, 12, 40):
        for s in range(sites):
            rows.append((i, f"body text number {i} which is long enough to stay\nline on {sites} sites", "en", f"site{s}"))
            i += 1
    return rows


def test_exact_at_the_threshold(spark):
    docs = documents(spark, rows_near_threshold())
    check(docs)
    removed = {r["doc_id"] for r in result(docs).where("n_removed > 0").collect()}
    assert len(removed) == 10 + 11 + 12 + 40


def test_hot_line_one_site_only(spark):
    check(documents(spark, [(i, f"{LICENSE}\nbody {i} of some length that stays here", "en", "one") for i in range(500)]))


def test_copies_over_sites_stay_whole(spark):
    docs = documents(spark, [(i, "a copied line\nanother copied line", "en", f"s{i}") for i in range(30)])
    check(docs)
    assert result(docs).where("n_removed > 0").count() == 0


def test_own_text_however_short_loses_spread_lines(spark):
    header = "a header of many words that stands on every page of every site"
    rows = [(i, f"{header}\nown {i}\n{LICENSE}", "en", f"s{i}") for i in range(12)]
    rows += [(20, f"{header}\n \t\n{LICENSE}\n", "en", "s0")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in result(documents(spark, rows)).collect()}
    assert got == {i: (f"own {i}", 3, 2) for i in range(12)} | {20: (rows[-1][1], 4, 0)}


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, "\n \n\t", None, None), (3, "x" * 200_000 + "\n" + LICENSE, "en", None)]
    rows += [(10 + i, f"{LICENSE}\n{LICENSE}\r\nkept text that is long enough to hold the greater share {i}", "en", f"s{i}") for i in range(12)]
    rows += [(10, f"{LICENSE}\n{LICENSE}\r\nkept text that is long enough to hold the greater share 0", "en", "s0")]
    docs = documents(spark, rows)
    check(docs)
    assert "size" in line_dedup.remove_spread_lines(docs).columns


def test_empty_table(spark):
    assert result(documents(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    docs = documents(spark, rows_near_threshold())
    plan = line_dedup.remove_spread_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
