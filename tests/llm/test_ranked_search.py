import math
import random
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
from helpers import connect, difference, documents, folder_tables

from eventbook.llm import ranked_search

SQL = ranked_search.ORACLE.replace("{documents}", "documents")


def check(docs):
    assert difference(ranked_search.search(docs, F.col("doc_id") % 100 == 0), connect(documents=docs), SQL) is None


def small(monkeypatch):
    monkeypatch.setattr(ranked_search, "GROUP_POSTINGS", 700)


def test_random_words_small_groups(spark, monkeypatch):
    small(monkeypatch)
    rnd = random.Random(6)
    words = [f"w{int(rnd.expovariate(0.02))}" for _ in range(4000)]
    rows = [(i * 5, " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for i in range(400)]
    docs = documents(spark, rows).repartition(9)
    index = docs.select("doc_id", "text").mapInArrow(ranked_search.build, ranked_search.INDEX)
    assert ranked_search.grouped(index).agg(F.max("group")).first()[0] >= 4
    check(docs)


def test_ties_and_odd_rows(spark):
    rows = [(i, "same words in every copy") for i in range(250)]
    rows += [(None, "same words"), (300, None), (400, ""), (500, "!!! ..."), (600, "alone"), (700, "Éa éa ÉA copy"), (700, "copy every"), (701, "x" * 100_000 + " copy")]
    check(documents(spark, rows))


def test_empty_table(spark):
    assert ranked_search.search(documents(spark, []), F.col("doc_id") % 100 == 0).count() == 0


def test_given_table(spark):
    check(folder_tables(spark, "documents")["documents"])


def row_of(shard, k):
    row = shard.index(k).to_pylist()[0]
    return row | {c: np.frombuffer(row[c], kind) for c, kind in ranked_search.BLOBS.items()}


def group_of(rnd, n, kinds, shards=3):
    """A group of random documents with few frequent and many rare terms, and its documents' scores by hand."""
    parts, terms_of = [], []
    for k in range(shards):
        shard = ranked_search.Shard()
        for i in range(n):
            words = [f"t{int(x)}" for x in rnd.zipf(1.3, int(rnd.integers(20, 200))) if x < kinds]
            shard.add(k * n + i, words, 1, HASHES)
            terms_of.append(words)
        parts.append(row_of(shard, k))
    return ranked_search.Group(parts, 90.0), terms_of


HASHES = ranked_search.Hashes()


def number(word):
    return int(np.uint64(HASHES[word]).view(np.int64))


def by_hand(terms_of, query, idf, k, own):
    found = []
    for d, words in enumerate(terms_of):
        tf, slow = Counter(words), 1.2 * (0.25 + 0.75 * len(words) / 90.0)
        score = sum(int(np.floor(1_000_000 * (idf[w] * (tf[w] * 2.2 / (tf[w] + slow))) + 0.5)) for w in query if w in tf)
        if score and d != own:
            found.append((score, d))
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def test_pruning_is_exact_and_skips():
    rnd = np.random.default_rng(3)
    group, terms_of = group_of(rnd, 700, 5000)
    df = Counter(w for words in terms_of for w in set(words))
    idf = {w: float(np.log(1 + (len(terms_of) - x + 0.5) / (x + 0.5))) for w, x in df.items()}
    lengths = []
    for d in [int(x) for x in rnd.choice(len(terms_of), 40, replace=False)] + [int(np.argmax([len(set(w)) for w in terms_of]))]:
        query = sorted(set(terms_of[d]), key=number)
        lengths.append(len(query))
        numbers, weights = np.array([number(w) for w in query]), np.array([idf[w] for w in query])
        want = by_hand(terms_of, query, idf, 10, d)
        assert group.best(d, numbers, weights, 10, 0) == want
        for at in (0, 4, 9):
            least = want[at][0] - 1
            assert group.best(d, numbers, weights, 10, least) == [x for x in want if x[0] > least]
    assert group.read < 0.6 * group.asked


def test_blocks_are_skipped_for_long_queries():
    # Queries of over 100 terms: most postings are those of frequent words, which are put off.
    rnd = np.random.default_rng(5)
    group, _ = group_of(rnd, 2000, 3000, shards=2)
    topic = [f"topic{k}" for k in range(60)]
    shard = ranked_search.Shard()
    for i in range(30):
        shard.add(10_000 + i, topic[: 60 - i] + [f"t{k}" for k in range(1, 80)], 1, HASHES)
    full = ranked_search.Group([row_of(shard, 9)], 90.0)
    query = sorted(topic + [f"t{k}" for k in range(1, 80)], key=number)
    numbers = np.array([number(w) for w in query])
    weights = np.array([8.0 if w.startswith("topic") else 0.2 for w in query])
    best = full.best(10_000, numbers, weights, 10, 0)
    assert len(query) > 100 and len(best) == 10
    # The other group starts from the k-th score and has nothing to add.
    assert group.best(10_000, numbers, weights, 10, best[-1][0] - 1) == []
    assert group.read == 0 and group.asked > 0


def plain_search(rows, k=10):
    """BM25 of whole documents without an index, in whole millionths."""
    tfs = [Counter(text.split()) for _, text in rows]
    df, n = Counter(w for tf in tfs for w in tf), len(rows)
    mean = sum(sum(tf.values()) for tf in tfs) / n
    out = []
    for (query_id, _), query in zip(rows, tfs, strict=True):
        if query_id % 100 == 0:
            found = []
            for (doc_id, _), tf in zip(rows, tfs, strict=True):
                slow = 1.2 * (0.25 + 0.75 * sum(tf.values()) / mean)
                shared = [w for w in query if w in tf and df[w] > 1]
                idf = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in shared}
                if shared and doc_id != query_id:
                    found.append((-sum(math.floor(1_000_000 * (idf[w] * (tf[w] * 2.2 / (tf[w] + slow))) + 0.5) for w in shared), doc_id))
            out += [(query_id, rank, doc_id, -s) for rank, (s, doc_id) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_query_is_the_whole_document(spark, tmp_path):
    from eventbook.llm.catalog import QUERIES

    rnd = random.Random(8)
    rows = [(i * 5, " ".join(f"w{int(rnd.expovariate(0.01))}" for _ in range(rnd.randint(30, 90)))) for i in range(300)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_ranked_search"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"] * 1_000_000)) for r in got) == plain_search(rows)


def test_a_task_holds_one_group(spark, monkeypatch):
    small(monkeypatch)
    original = ranked_search.answering

    def watched(*of):
        answer = original(*of)

        def run(batches):
            def seen():
                groups = set()
                for batch in batches:
                    groups.update(batch.column("group").to_pylist())
                    assert len(groups) <= 1, groups
                    yield batch

            yield from answer(seen())

        return run

    monkeypatch.setattr(ranked_search, "answering", watched)
    rnd = random.Random(8)
    rows = [(i * 5, " ".join(f"w{int(rnd.expovariate(0.02))}" for _ in range(rnd.randint(0, 40)))) for i in range(400)]
    check(documents(spark, rows).repartition(9))


def test_postings_take_three_bytes_and_large_frequencies_are_kept():
    words = [["a"] * 254 + ["b"] * 255 + ["c"] * 70_000 + ["d"], ["c", "b"], ["a"] * 300]
    hashes, parts = ranked_search.Hashes(), []
    for texts in (words, words[::-1], [["b", "a"], []], [[]]):
        shard = ranked_search.Shard()
        for k, text in enumerate(texts):
            shard.add(10 * len(parts) + k, text, 1, hashes)
        parts.append(row_of(shard, len(parts)))
    assert sum(parts[0][c].nbytes for c in ("docs", "tfs")) == 3 * 7 and parts[0]["large"].tolist().count(70_000) == 1
    group = ranked_search.Group(parts, 90.0)
    found = {}
    for term in "abcd":
        at = int(np.searchsorted(group.terms, number(term)))
        assert group.terms[at] == number(term)
        part = slice(group.begins[at], group.ends[at])
        found[term] = list(zip(group.ids[group.docs[part]].tolist(), group.tfs[part].tolist(), strict=True))
    assert found["a"] == [(0, 254), (2, 300), (10, 300), (12, 254), (20, 1)]
    assert found["b"] == [(0, 255), (1, 1), (11, 1), (12, 255), (20, 1)]
    assert found["c"] == [(0, 70_000), (1, 1), (11, 1), (12, 70_000)] and found["d"] == [(0, 1), (12, 1)]
    assert ranked_search.Group(parts[3:], 90.0).best(1, np.array([number("a")]), np.ones(1), 10, 0) == []


def test_queries_are_not_sent_to_each_group(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "GROUP_POSTINGS", 100)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 60)
    rnd = random.Random(9)
    rows = [(i * 5, " ".join(f"w{int(rnd.expovariate(0.02))}" for _ in range(rnd.randint(0, 40)))) for i in range(400)]
    docs, sent = documents(spark, rows).repartition(24), []
    kind = type(docs)
    original = kind.repartitionById

    def watched(self, *of):
        sent.append((self.where("terms_of IS NOT NULL").count(), self.where("docs IS NOT NULL").count() if "docs" in self.columns else 0))
        return original(self, *of)

    with monkeypatch.context() as patched:
        patched.setattr(kind, "repartitionById", watched)
        check(docs)
    index = docs.select("doc_id", "text").mapInArrow(ranked_search.build, ranked_search.INDEX)
    n_groups, n_queries = ranked_search.grouped(index).agg(F.max("group")).first()[0] + 1, docs.where("doc_id % 100 = 0 AND text <> ''").count()
    turns = len(ranked_search.turns_of(n_groups, spark.sparkContext.defaultParallelism)) - 1
    # Once to a group, once to a block in each turn; the index once.  It was once to each group.
    assert n_queries and n_groups > 3 * (1 + turns)
    assert sum(x for x, _ in sent) <= n_queries * (1 + turns) and sum(x for _, x in sent) == 24


def test_turns_widen():
    assert ranked_search.turns_of(1, 8) == [0, 1] and ranked_search.turns_of(0, 8) == [0]
    assert ranked_search.turns_of(20, 8) == [0, 8, 20]
    assert ranked_search.turns_of(1000, 6) == [0, 6, 24, 96, 384, 1000]


def test_stored_groups_are_as_before():
    rnd = np.random.default_rng(4)
    parts = []
    for k in range(3):
        shard = ranked_search.Shard()
        for i in range(300):
            shard.add(1000 * k + i, [f"t{int(x)}" for x in rnd.zipf(1.3, 60) if x < 500] + ["many"] * int(rnd.integers(0, 400)), 1, HASHES)
        parts.append(row_of(shard, k))
    group = ranked_search.Group(parts, 90.0)
    row = group.stored(7, 2).to_pylist()[0]
    assert (row["group"], row["turn"], row["n_docs"], row["query_id"]) == (7, 2, 900, None)
    again = ranked_search.Group([{c: np.frombuffer(row[c], kind) for c, kind in ranked_search.BLOBS.items()} | {"n_docs": 900}], 90.0)
    assert again.tfs.max() > ranked_search.LARGE
    for name in ("ids", "lengths", "terms", "begins", "ends", "docs", "tfs", "slow"):
        assert np.array_equal(getattr(group, name), getattr(again, name)), name


def test_sums_of_scores_pass_32_bits():
    rnd = np.random.default_rng(6)
    group, terms_of = group_of(rnd, 300, 200)
    query = sorted(set(terms_of[5]), key=number)
    idf = {w: 600.0 + k for k, w in enumerate(query)}
    want = by_hand(terms_of, query, idf, 10, 5)
    assert want[9][0] > 1 << 32
    weights = np.array([idf[w] for w in query])
    for least in (0, want[4][0] - 1):
        assert group.best(5, np.array([number(w) for w in query]), weights, 10, least) == [x for x in want if x[0] > least]
