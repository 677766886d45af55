import hashlib
import math
import random
import re
import zlib

import pytest
from helpers import connect, difference

from eventbook.llm import prefix_trie
from eventbook.llm.prefix_trie import half_depths

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def by_hand(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs_ in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = sorted(c for c in convs_ if len(whole[c]) == len(node))
        out.append((
            min(convs_), len(node), min(members[node[:-1]]) if node else None, len(convs_), sum(len(x) == len(node) + 1 for x in below), sum(map(leaf, below)),
            sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3) for r in rows], SCHEMA)


def compare(spark, rows, sql=True):
    conversations = frame(spark, rows)
    found = prefix_trie.conversation_trie(conversations)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == by_hand(rows)
    if sql:
        assert difference(found, connect(conversations=conversations), prefix_trie.ORACLE.replace("{conversations}", "conversations")) is None
    return got


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "hello there"), (0, 2, "bot", "hi"), (0, 3, "user", "one two three"), (1, 1, "user", "hello there"), (1, 2, "bot", "hi"), (1, 3, "user", "other words"),
        (2, None, "user", "without a number"), (2, 0, "user", "zero"), (2, 0, "bot", "zero"), (2, 0, "bot", "zero"), (3, 1, None, None), (3, 2, "", ""), (3, 3, None, ""),
        (None, 1, "user", "no conversation"), (41, 1, "user", "alone"), (44, 1, "user", "alone"), (45, 1, "a", "bc"), (46, 1, "ab", "c"), (-3, 1, "user", "below zero"), (-20, 1, "user", "x"),
        (20, 5, "user", "late"), (20, 1, "user", "early"), (21, 1, "user", "own one"), (21, 2, "user", "own two"), (21, 3, "user", "own three"), (21, 4, "user", "own four"),
    ]
    got = compare(spark, rows)
    assert any(r[1] == 0 for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(400), 120):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            rows += [(conv, rng.choice([turn, turn, None]), rng.choice(["user", "bot"]), " ".join("ab"[: rng.randrange(3)]))] * rng.choice([1, 1, 1, 2])
    compare(spark, rows)


def test_hot_first_turn_and_copies(spark):
    # A third of all conversations are one turn and end there; others go on from it.
    rows = [(c, 0, "user", "the same question") for c in range(0, 600)] + [(c, 1, "bot", f"answer {c % 3}") for c in range(0, 600, 3)]
    got = compare(spark, rows)
    assert max(r[3] for r in got if r[1] == 1) > 200


def test_one_very_long_conversation(spark):
    rows = [(7, t, "user", f"turn {t % 5}") for t in range(400)] + [(c, t, "user", f"turn {t % 5}") for c in (8, 9) for t in range(c)]
    got = compare(spark, rows, sql=False)
    assert max(r[1] for r in got) >= 390


def test_turnless_and_empty(spark):
    # Conversations whose turns are all replaced by those of a block start that is not there.
    short = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1][:5]
    got = compare(spark, [(c, 1, "user", "gone") for c in short])
    assert [r[1] for r in got] == [0] and got[0][3] == 5
    assert prefix_trie.conversation_trie(frame(spark, [(None, 1, "user", "x")])).collect() == []
    assert prefix_trie.conversation_trie(frame(spark, [(1, 1, "u", "x")]).where("conv_id > 1")).collect() == []


def test_pieces_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    ends = spark.createDataFrame([(d, n, c) for d, n, m in ((0, 1, 900), (1, 1, 3), (1, 2, 1), (2, 5, 700)) for c in range(m)], "depth long, name long, conv long").repartition(7)
    found = {(r.depth, r.name): r.ends_sha256 for r in prefix_trie.hash_of_ends(ends).collect()}
    wanted = {(d, n): hashlib.sha256(",".join(map(str, range(m))).encode()).hexdigest() for d, n, m in ((0, 1, 900), (1, 1, 3), (1, 2, 1), (2, 5, 700))}
    assert found == wanted


def test_levels():
    for longest in range(1, 70):
        halves, depths = half_depths(longest), []
        for half in halves:
            depths += [d for d in range(1, longest + 1) if d % (2 * half) == half]
        assert sorted(depths) == list(range(1, longest + 1)) and len(halves) == longest.bit_length()
