import random

import numpy as np
from helpers import documents, folder_tables

from eventbook.llm import near_dedup, shingles


def words_of(text):
    import re

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def brute(rows):
    """doc_id, n_shingles, component_id, kept by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def check(spark, rows):
    got = near_dedup.group_near(documents(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def edited(rnd, text, share):
    return " ".join(f"w{rnd.randint(0, 9999)}" if rnd.random() < share else w for w in text.split())


def test_groups_of_near_copies(spark):
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randint(0, 9999)}" for _ in range(120)) for _ in range(6)]
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    for i in range(160):
        rows.append((i, edited(rnd, texts[i % 3], rnd.choice([0, 0.01, 0.02, 0.03, 0.05]))))
    # A chain in which the ends are far apart, and a passage that many share.
    chain = texts[4].split()
    for i in range(12):
        chain[i * 8 : i * 8 + 3] = [f"c{i}x", f"c{i}y", f"c{i}z"]
        rows.append((500 + i, " ".join(chain)))
    rows += [(600 + i, texts[5][:300] + " " + " ".join(f"u{rnd.randint(0, 9999)}" for _ in range(60))) for i in range(40)]
    check(spark, rows)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(None, None), (None, "a b c d e f"), (4, "A b C d e F"), (4, "A b C d e F"), (5, ""), (6, " \n"), (7, "one two"), (8, "ONE\ttwo"), (9, "two one")]
    rows += [(10, long), (11, long + " more"), (12, None), (3, "a b c d e f"), (13, "é É"), (14, "É é")]
    check(spark, rows)


def test_empty_table(spark):
    assert near_dedup.group_near(documents(spark, [])).count() == 0


def test_given_table(spark):
    docs = folder_tables(spark, "documents")["documents"]
    got = near_dedup.group_near(docs).collect()
    assert sorted(map(tuple, got), key=repr) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_sketches_fill_and_estimate():
    rnd = np.random.default_rng(1)
    common = rnd.integers(0, 2**63, 300).astype(np.uint64)
    a = np.unique(np.r_[common, rnd.integers(0, 2**63, 100).astype(np.uint64)])
    one = np.array([5], np.uint64)
    both = shingles.sketches(np.r_[a, np.unique(common), one], np.array([len(a), len(np.unique(common)), 1, 0]))
    assert not (both[:3] == shingles.EMPTY).any()
    assert abs((both[0] == both[1]).mean() - 0.75) < 0.15


def test_one_row_of_each_group_stays(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(3, a), (7, b), (7, a + " more"), (8, a), (9, ""), (9, ""), (10, None), (None, b + " x"), (11, b), (12, "own words"), (12, "own words"), (12, "other words")]
    docs = documents(spark, rows)
    stays = near_dedup.first_of_groups(docs)
    assert stays.columns == docs.columns
    want = [(3, a), (7, b), (9, ""), (10, None), (12, "own words"), (12, "other words")]
    assert sorted(((r.doc_id, r.text) for r in stays.collect()), key=repr) == sorted(want, key=repr)
    # Two texts of the smallest id in one group: one of them.
    same = [r.text for r in near_dedup.first_of_groups(documents(spark, [(1, a), (1, a + " x"), (2, a + " y")])).collect()]
    assert len(same) == 1 and same[0] in (a, a + " x")
