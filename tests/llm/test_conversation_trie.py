from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from kgspark.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """conv_id -> turns (role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by[conv].append((turn is not None, turn or 0, role, name, text))
    return {c: [(r[2], r[4]) for r in sorted(t, key=lambda r: r[:4])] for c, t in by.items()}


def heads_swapped(convs):
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = convs.get(base, [])[:h] + own[h:]
    return made


def brute(convs):
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    found = []
    for node, ids in members.items():
        under = [n for n in members if n[: len(node)] == node]
        children = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in under)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        found.append((min(ids), len(node), parent, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.drop("digest").collect()), key=repr)


@pytest.mark.parametrize("again", [False, True])
def test_equals_brute_force(spark, sf, again):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    if again:
        rows += [(c + 1000, *r) for c, *r in rows if c % 3 == 0]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(trie.prefix_trie(trie.rebuilt(trie.turns(df)))) == brute(heads_swapped(ordered(rows)))
    assert got(trie.prefix_trie(trie.marked(trie.turns(df)))) == brute(ordered(rows))


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            rows.append((c - 20, t, "user" if t % 2 else "assistant", rng.choice("abé")))
    rng.shuffle(rows)
    return rows


def test_shared_prefixes_and_negative_ids(spark):
    rows = random_rows(1, 120, 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(trie.prefix_trie(trie.marked(trie.turns(df)))) == brute(ordered(rows))
    assert got(trie.prefix_trie(trie.rebuilt(trie.turns(df)))) == brute(heads_swapped(ordered(rows)))


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, "a", None), (1, None, None, "é"), (1, None, None, None), (2, None, "", ""), (None, 1, "user", "x"), (6, 0, "ab", "c"), (7, 0, "a", "bc"), (12, 3, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS depth", "'x' AS digest", "'x' AS place", "'x' AS h", "'x' AS parent")
    assert got(trie.prefix_trie(trie.rebuilt(trie.turns(df)))) == brute(heads_swapped(ordered(rows)))
    assert got(trie.prefix_trie(trie.marked(trie.turns(df)))) == brute(ordered(rows))


def test_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert got(trie.prefix_trie(trie.rebuilt(trie.turns(df)))) == []


def test_very_many_copies_and_a_very_long_conversation(spark, monkeypatch):
    """Parts of ids are cut, and neither gives rows in the square."""
    monkeypatch.setattr(trie, "PART", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(2)] + [(c, t, "user", f"turn {t}" * (t % 50)) for c in (1000, 1001) for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    found = {(r.conv_id, r.depth): r for r in trie.prefix_trie(trie.marked(trie.turns(df))).collect()}
    assert found[0, 2].ends_sha256 == hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()
    assert (found[0, 0].n_convs, found[0, 0].n_leaves, found[0, 0].n_children) == (402, 2, 2)
    deep = sum(len(f"turn {t}" * (t % 50)) for t in range(3000))
    assert found[1000, 1].saved_tokens == deep
    assert found[0, 0].saved_tokens == deep + 399 * 12
    assert (found[1000, 3000].n_children, found[1000, 3000].n_leaves, found[1000, 3000].parent_conv_id) == (0, 1, 1000)
    assert len(found) == 1 + 2 + 3000


def test_the_query_has_the_columns_of_its_contract(spark, sf):
    kinds = dict(trie.op12_conversation_trie(spark, sf).dtypes)
    assert kinds.pop("ends_sha256") == "string"
    assert kinds == dict.fromkeys("conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens".split(), "bigint")
