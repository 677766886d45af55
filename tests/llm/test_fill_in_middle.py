import hashlib
import re

import pytest
from helpers import connect, difference, documents

from eventbook.llm import fill_in_middle as fim

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", text, None, None
    if h[3] % 100 < 20:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


ODD = [
    (1, "one two three"), (2, None), (3, ""), (4, " \n\r\x85 "), (5, "a <P> in it"), (6, "ends <"), (7, "S> starts"), (8, "<M"), (9, "$1 \\Q [x] {2} $"),
    (10, "żółć 😀😀 café"), (10, "other text of ten"), (10, "other text of ten"), (None, "no id at all"), (None, None), (12, "x"), (13, "\n"), (14, "wörd " * 3), (-5, "below zero <"),
]


def rows_of(frame):
    return sorted(((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in frame.collect()), key=repr)


def test_odd_rows_by_hand(spark):
    rows = ODD + [(k, f"Text {k}: it's <b>{'ab ' * (k % 7)}</b>") for k in range(100, 300)]
    found = fim.fill_in_middle(documents(spark, rows))
    assert rows_of(found) == sorted(((i, *by_hand(i, t)) for i, t in rows), key=repr)
    assert {r[2] for r in rows_of(found)} == {"plain", "psm", "spm"}


def test_round_trip_and_sql(spark):
    docs = documents(spark, ODD + [(k, "Ünit by unit, " * (k % 5) + "<" * (k % 3)) for k in range(20, 120)])
    done = fim.fill_in_middle(docs)
    back = done.select("doc_id", fim.restored(done.output, done.form).alias("text")).collect()
    wanted = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert sorted(map(tuple, back), key=repr) == sorted(wanted, key=repr)
    assert difference(fim.digests(docs), connect(documents=docs), fim.ORACLE.format(documents="documents")) is None


def test_very_long_texts(spark):
    rows = [(k, body) for k, body in enumerate(["a" * 3_000_000, "a b" * 700_000, "é" * 1_000_000, "\n" * 1_000_000, "word " * 400_000])]
    found = fim.fill_in_middle(documents(spark, rows))
    assert rows_of(found) == sorted(((i, *by_hand(i, t)) for i, t in rows), key=repr)


def test_other_parameters_and_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 9, "x"), (2, "d e f", 9, "y")], "key long, body string, n int, form string")
    found = fim.fill_in_middle(docs, "key", "body", marked=100, suffix_first=100)
    assert found.columns == ["key", "body", "n", "form", "output", "prefix_chars", "middle_chars"]
    assert {r.form for r in found.collect()} == {"spm"} and {r.n for r in found.collect()} == {5}


def test_empty_table_and_plan(spark):
    empty = documents(spark, [(1, "x")]).where("doc_id > 1")
    assert fim.digests(empty).collect() == []
    plan = fim.digests(documents(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("seed", ["1", "2"])
def test_seed(spark, seed):
    found = fim.fill_in_middle(documents(spark, [(k, "some words of text here") for k in range(50)]), seed=seed)
    assert len({(r.prefix_chars, r.middle_chars) for r in found.collect()}) > 10
