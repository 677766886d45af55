import math
import random
import struct
import zlib
from collections import defaultdict

import pytest
from helpers import documents
from tokenizers import Tokenizer

from eventbook.llm import packing
from eventbook.llm.catalog import VOCABULARY


def check(spark, rows, **options):
    library = Tokenizer.from_file(VOCABULARY)
    got = packing.pack(documents(spark, rows), VOCABULARY, with_ids=True, **options).collect()
    want = defaultdict(int)
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (a, b) in enumerate(packing.cut_points(len(ids), 1024)):
            want[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])), tuple(ids[a:b])] += 1
    found = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        found[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    return len(sequences), sum(r["length"] for r in got)


def test_small_and_large(spark):
    rnd = random.Random(2)
    rows = [(i, "word " * rnd.choice([0, 3, 10, 60, 150, 300, 400, 700, 1023, 1024, 2500])) for i in range(300)]
    rows += [(None, None), (5, "same row"), (5, "same row"), (7, ""), (8, "hello" * 9000)]
    used, tokens = check(spark, rows)
    assert used <= math.ceil(tokens / 1024) * 1.03 + 2


def test_all_alike(spark):
    used, _ = check(spark, [(i, None) for i in range(3000)])
    assert used == math.ceil(3000 / 1024)
    used, _ = check(spark, [(i, "word " * 510) for i in range(41)])
    assert used == 21


def test_few_groups_still_fit(spark):
    rnd = random.Random(3)
    check(spark, [(i, "word " * rnd.randint(0, 900)) for i in range(200)], groups=4)


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plans_hold_every_piece(seed):
    rnd = random.Random(seed)
    counts = {rnd.randint(65, 1024): rnd.randint(1, 50) for _ in range(rnd.randint(1, 60))}
    groups = packing.grouped(counts, rnd.choice([3, 20, 512]))
    assert sum(n for _, n in groups) == sum(counts.values())
    found = packing.configurations(groups, 1024)
    held = defaultdict(int)
    for times, uses in found:
        assert sum(s * n for s, n in uses.items()) <= 1024
        for s, n in uses.items():
            held[s] += n * times
    assert dict(held) == dict(groups)
    small = {rnd.randint(1, 64): rnd.randint(1, 500) for _ in range(20)}
    room = {rnd.randint(1, 900): rnd.randint(1, 40) for _ in range(20)}
    where, new = packing.small_places(small, room, 1024)
    fills = defaultdict(int)
    for length, n in small.items():
        rows = where[length].tolist()
        for (rank, kind, first, each), end in zip(rows, [r[0] for r in rows[1:]] + [n], strict=True):
            for k in range(rank, end):
                fills[kind, first + (k - rank) // each] += length
    for (kind, nth), held_ in fills.items():
        assert held_ <= (1024 if kind < 0 else kind)
        assert nth < (new if kind < 0 else room[kind])
