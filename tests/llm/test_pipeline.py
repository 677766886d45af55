"""Each stage of the pipeline against what its operator says, on the smallest tables."""

import re

import duckdb
import pytest
from helpers import FOLDER, documents
from pyspark.sql import functions as F

import corpus_pipeline
from eventbook.llm import language, line_dedup, mixing, near_dedup, token_counts
from eventbook.llm.catalog import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = documents(spark, [(9001, None), (9002, "12 34"), (9003, "  ")]).select(*COLUMNS)
    return given.unionByName(odd)


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing"]


def test_language_stage(spark, docs):
    out = STAGES["language ID"](spark, docs, FOLDER)
    assert out.columns == COLUMNS
    assert ids(out) == ids(language.identify(docs).where("NOT rejected"))
    assert not {9001, 9002, 9003} & set(ids(out)) and len(ids(out)) >= docs.count() - 4


def test_line_stage(spark, docs):
    out = STAGES["line dedup"](spark, docs, FOLDER)
    assert out.columns == COLUMNS and ids(out) == ids(docs)
    want = {r["doc_id"]: r["text"] for r in line_dedup.remove_spread_lines(docs).collect()}
    assert all(r["text"] == want[r["doc_id"]] and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())


def test_near_stage(spark, docs):
    twice = docs.unionByName(docs.where("doc_id < 20"))
    out = STAGES["MinHash near-dedup"](spark, twice, FOLDER)
    assert out.columns == COLUMNS
    assert ids(out) == sorted({r["doc_id"] for r in near_dedup.group_near(twice).where("kept").collect()}, key=repr)


def test_rows_of_one_id_are_told_apart(spark):
    a, b = " ".join(f"one{k}" for k in range(50)), " ".join(f"two{k}" for k in range(50))
    rows = documents(spark, [(3, a, "en", "s"), (7, b, "en", "s"), (7, a + " more", "en", "s"), (None, b + " x", "en", "s")]).select(*COLUMNS)
    assert sorted(r["text"] for r in STAGES["MinHash near-dedup"](spark, rows, FOLDER).collect()) == [a, b]


def test_empty_table_and_odd_columns_through_all_stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id < 0"), FOLDER).count() == 0, name
    extra = {c: F.lit(1) for c in ("score", "rejected", "text_", "kept_id", "lang_pred", "cross_entropy", "n_lines", "n_removed", "hits_", "near_id", "place", "part", "count", "size", "taken")}
    rows = docs.where("doc_id < 60").unionByName(docs.where("doc_id < 20").withColumn("doc_id", F.lit(None).cast("long"))).withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, FOLDER)
        assert out.columns == rows.columns, name
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER).count() > 0


def test_composition_by_hand(spark, tmp_path):
    """The first four stages over lines, near copies and sources, against plain Python that knows the languages kept."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [r.asDict() for r in STAGES["language ID"](spark, given, FOLDER).collect()]
    sites = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if line.translate(str.maketrans("", "", " \t\x0b\x0c\r")) and r["source"] is not None:
                sites.setdefault(line, set()).add(r["source"])
    spread = {line for line, of in sites.items() if len(of) >= line_dedup.MIN_SITES}
    for r in rows:
        left = "\n".join(x for x in r["text"].split("\n") if x not in spread)
        if left.translate(str.maketrans("", "", " \t\x0b\x0c\r\n")):
            r["text"] = left
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()})
    up = list(range(len(rows)))
    def top(i):  # noqa: E306
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append((r["doc_id"], i))
    kept = [rows[min(g)[1]] for g in groups.values()]
    before_mix = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in kept], given.schema)
    con = duckdb.connect()
    con.register("documents_", before_mix.toArrow())
    con.execute("CREATE TABLE documents AS SELECT * FROM documents_")
    want = {}
    for doc_id, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE.format(documents='documents')})").fetchall():
        if taken:
            want[doc_id] = taken // size
    docs_ = given
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs_ = stage(spark, docs_, FOLDER)
    got = docs_.groupBy("doc_id", "text").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == want
    assert {r["doc_id"]: r["text"] for r in got} == {r["doc_id"]: r["text"] for r in kept if r["doc_id"] in want}


def test_mix_stage(spark, docs):
    out = STAGES["mixing sources to target weights"](spark, docs, FOLDER)
    assert out.columns == COLUMNS
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    words = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    assert words == {i: n for i, n in taken.items() if n}


def test_pack_stage(spark, docs):
    out = STAGES["best-fit packing"](spark, docs, FOLDER)
    tokens = token_counts.count_tokens(docs, VOCABULARY).agg(F.sum("n_tokens"), F.count("*")).first()
    assert out.agg(F.sum("length")).first()[0] == tokens[0] + tokens[1]
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
