from __future__ import annotations

import random
import re

import pytest

from kgspark.llm.components import components
from kgspark.llm.jaccard_join import jaccard_components
from kgspark.llm.shingles import shared


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id or 0, len(s), least.get(find(i), 0) if s else doc_id or 0) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(df, *args):
    return sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_components(df, *args).collect())


@pytest.mark.parametrize(("n", "percent", "small", "most"), [(3, 90, 16, 50_000), (5, 80, 2, 8)])
def test_equals_brute_force(docs, n, percent, small, most):
    assert got(docs, n, percent, small, most) == brute([(r.doc_id, r.text) for r in docs.collect()], n, percent)


@pytest.mark.parametrize(("small", "most"), [(4, 50_000), (40, 50_000), (4, 16)])
def test_a_large_group_of_near_copies(spark, small, most):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(150, 220):  # shared in part: most do not link
        w = [*base[: 100 + i % 21], *[f"o{rng.randrange(10**6)}" for _ in range(i % 9)]]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 3, 90, small, most) == brute(rows, 3, 90)


def test_words_whose_letters_follow_a_thue_morse_sequence(spark):
    """Such words and their complements collide under polynomial hashes modulo 2**64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"{a} {b} {a} {b}"), (4, f"{b} {a} {b} {a}")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90) == brute(rows, 3, 90)


def test_pairs_are_verified_on_the_shingles_themselves():
    rng = random.Random(9)
    left, right = ([" ".join(rng.choice("abcAB") for _ in range(rng.randrange(12))) for _ in range(300)] for _ in range(2))
    for words in (1, 3, 5):
        na, nb, both = shared([t.encode() for t in left], [t.encode() for t in right], words)
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            x, y = shingles(x, words), shingles(y, words)
            assert (na[i], nb[i], both[i]) == (len(x), len(y), len(x & y))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.node: r.comp for r in components(links).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_odd_rows(odd, nothing):
    assert got(odd, 3, 90) == brute([(r.doc_id, r.text) for r in odd.collect()], 3, 90)
    assert got(nothing) == []
