import random

from helpers import connect, difference, documents

from eventbook.llm import mixing


def check(docs):
    got = mixing.mix(docs).drop("source")
    assert difference(got, connect(documents=docs), mixing.ORACLE.format(documents="documents")) is None
    return mixing.mix(docs)


def test_against_sorting(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randint(0, 60), "en", rnd.choice(["a"] * 8 + ["b", "c", "d", "é", None])) for i in range(3000)]
    mixed = check(documents(spark, rows)).groupBy("source").agg({"taken": "sum", "target": "max", "size": "sum"}).collect()
    for r in mixed:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 60


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, "a b", None, "x"), (1, "", None, "x"), (2, " \t\n", None, "only blanks")]
    rows += [(7, "one two three four five", None, "copies")] * 40
    rows += [(9, "word " * 5000, None, "long"), (10, "x", None, "long")]
    check(documents(spark, rows))


def test_one_source_and_none(spark):
    check(documents(spark, [(i, "a b c", None, "s") for i in range(50)]))
    check(documents(spark, [(1, None, None, "s")]))
    assert mixing.mix(documents(spark, [])).count() == 0


def test_documents_of_the_mix(spark):
    docs = documents(spark, [(i, f"some words of document {i}", "en", "ab"[i % 2]) for i in range(200)])
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert times == {i: n for i, n in taken.items() if n}


def test_repeated_rows_at_the_threshold_come_whole(spark):
    rows = [(1, "a  b c\nd e", "en", "s")] * 10 + [(2, "z " * 10, "en", "t")]
    docs = documents(spark, rows)
    check(docs)
    taken = mixing.mix(docs).collect()
    assert {r["taken"] % r["size"] for r in taken} == {0}
    # Some of the ten are taken once more than the others.
    assert {abs(sum(r["taken"] for r in taken if r["source"] == s) - max(r["target"] for r in taken if r["source"] == s)) <= 5 for s in "st"} == {True}
    texts = [r["text"] for r in mixing.mixed_documents(docs).collect()]
    assert set(texts) == {"a  b c\nd e", "z " * 10} and texts.count("a  b c\nd e") == sum(r["taken"] // r["size"] for r in taken if r["doc_id"] == 1)


def test_null_ids_are_told_apart_by_texts(spark):
    rows = [(None, f"one two\nthree four {k}", "en", "x") for k in range(10)] + [(5, f"six seven {k % 4}", "en", "x") for k in range(10)] + [(k, "w " * 40, "en", "y") for k in range(6, 9)]
    docs = documents(spark, rows)
    check(docs)
    assert {r["text"] for r in mixing.mixed_documents(docs).collect()} <= {r[1] for r in rows}


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2, 3)] * 5 + [(2, "c", "s", 4, 5, 6)] * 3, "doc_id long, text string, source string, place_ int, size int, taken int")
    got = mixing.mixed_documents(docs.withColumnRenamed("place_", "place"))
    assert got.columns == ["doc_id", "text", "source", "place", "size", "taken"] and got.count() > 0
