import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import tries

SCHEMA = "conv_id long, turn int, role string, text string, key string, size int, head long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}


def nodes(sequences):
    """Every prefix by itself, in plain Python."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def found(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in df.collect())


def corpus():
    rng = random.Random(8)
    say = lambda: (rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "", None, "é😀", "x:y", "same"]))
    rows = []
    for c in range(-3, 250):
        rows += [(c, t, *say()) for t in rng.sample(range(12), rng.randint(1, 9))]
    for c in range(300, 360):  # a long shared chain with a fork at every turn
        rows += [(c, t, "user", f"chain {t}") for t in range(c - 300)] + [(c, 100, "user", f"end {c % 7}")]
    for c in range(400, 480):  # copies
        rows += [(c, t, "user", f"copy {t}") for t in range(5)]
    rows += [(500, None, "user", "first"), (500, None, "user", "also first"), (500, 3, "a", "b"), (500, 3, "a", "b"), (None, 1, "user", "lost"), (2**40, 1, "user", "far")]
    rows += [(c, 0, "user", "short") for c in range(601, 640)]  # no first conversation of the block: some are turnless
    return rows


@pytest.mark.parametrize("most", [5, 60, 10**6])
def test_trie_equals_plain_prefixes(spark, most):
    rows = corpus()
    own = ordered(rows)
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(__import__("math").fmod(c, 100))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    assert any(not t for t in whole.values())
    got = tries.prefix_trie(tries.rebuilt(table(spark, rows).repartition(5)), most)
    assert found(got) == nodes(whole)


def test_sequences_as_they_are_and_none_at_all(spark):
    rows = [(1, 1, "u", "a"), (2, 1, "u", "a"), (2, 2, "u", "b"), (3, 1, "ua", "")]
    got = tries.prefix_trie(tries.conversation_turns(table(spark, rows)))
    assert found(got) == nodes(ordered(rows))
    empty = tries.prefix_trie(tries.rebuilt(table(spark, [])))
    assert empty.collect() == [] and tries.prefix_trie(tries.rebuilt(table(spark, [(None, 1, "u", "a")]))).isEmpty()


def test_very_long_text_and_conversation(spark):
    rows = [(1, t, "u", "x" * (2_000_000 if t == 3 else 1)) for t in range(700)] + [(2, t, "u", "x") for t in range(3)]
    got = tries.prefix_trie(tries.conversation_turns(table(spark, rows)), 50)
    assert got.agg(F.max("depth"), F.count("*")).first() == (700, 701) and found(got) == nodes(ordered(rows))
