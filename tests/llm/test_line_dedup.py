from __future__ import annotations

import hashlib
import random

from kgspark.llm import line_dedup as s


def key(row) -> bytes:
    return hashlib.md5(f"{'' if row[0] is None else row[0]}\n{row[1] or ''}".encode()).digest()


def brute(rows):
    """Of every document, by comparing all pairs of places: lines in repeated runs of GUARANTEE words, and of LEAST words."""
    docs = {key(r): ((r[0] is None, r[0] or 0, key(r)), [(i, x, len(x.split())) for i, x in enumerate((r[1] or "").encode().split(b"\n")) if x.split()]) for r in rows}
    places: dict[bytes, list] = {}
    for k, (_, lines) in docs.items():
        for j, (_, x, _) in enumerate(lines):
            places.setdefault(x, []).append((k, j))
    must: dict[bytes, set] = {k: set() for k in docs}
    may: dict[bytes, set] = {k: set() for k in docs}
    for k, (rank, lines) in docs.items():
        for j, (_, x, _) in enumerate(lines):
            for k0, i in places[x]:
                rank0, other = docs[k0]
                if (rank0, i) >= (rank, j) or (i and j and other[i - 1][1] == lines[j - 1][1]):
                    continue  # not earlier, or not where a common run begins
                n = 0
                while i + n < len(other) and j + n < len(lines) and other[i + n][1] == lines[j + n][1]:
                    n += 1
                words = sum(w for _, _, w in lines[j : j + n])
                run = {lines[y][0] for y in range(j, j + n)}
                if words >= s.GUARANTEE:
                    must[k] |= run
                if words >= s.LEAST:
                    may[k] |= run
    return docs, must, may


def check(df):
    rows = {(r.doc_id, r.text) for r in df.collect()}
    docs, must, may = brute(rows)
    runs = {bytes(r.k): {i for x in r.runs for i in range(x.begin, x.end)} for r in s.repeated_runs(df).collect()}
    assert runs.keys() <= docs.keys()
    for k, (_, lines) in docs.items():
        gone = {i for i, _, _ in lines} & runs.get(k, set())
        assert must[k] <= gone <= may[k]
    text = sorted((str(r.doc_id), r.text) for r in s.line_dedup(df).collect())
    left = [(str(r.doc_id), "\n".join(x for i, x in enumerate((r.text or "").split("\n")) if i not in runs.get(key((r.doc_id, r.text)), ()))) for r in df.collect()]
    assert text == sorted(left)
    return sum(map(len, must.values()))


def test_guarantee_and_soundness_on_documents(docs):
    assert check(docs) > 100


def test_guarantee_on_runs_of_many_shapes(spark):
    draw = random.Random(5)
    pool = [[" ".join(f"p{i}w{draw.randrange(10**6)}" for _ in range(draw.choice((1, 2, 5, 9, 14, 24, 40)))) for _ in range(draw.randint(2, 14))] for i in range(25)]
    rows = []
    for i in range(250):
        lines = []
        for _ in range(draw.randint(1, 4)):
            block = draw.choice(pool)
            a = draw.randrange(len(block))
            lines += block[a : draw.randint(a + 1, len(block))] + [f"own {i} {draw.random()}", ""]
        rows.append((None if i % 50 == 7 else i // 2, "\n".join(lines)))
    assert check(spark.createDataFrame(rows, "doc_id long, text string")) > 300


def got(df):
    return sorted((r.doc_id or 0, r.text) for r in s.line_dedup(df).collect())


def test_a_shared_passage_stays_once(spark):
    passage = " ".join(f"shared{i}" for i in range(60)) + "."
    rows = [(i, f"Start {i} of a document.\n{passage}\nEnd {i} of a document.") for i in range(5)]
    kept = dict(got(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [passage in kept[i] for i in range(5)] == [True, False, False, False, False]
    assert kept[3] == "Start 3 of a document.\nEnd 3 of a document."


def test_equal_ids_with_different_texts_share_a_line_of_fifty_words(spark):
    passage = " ".join(f"shared{i}" for i in range(50))
    rows = [(1, f"One.\n{passage}"), (1, f"Two.\n{passage}"), (1, f"Two.\n{passage}")]
    texts = [t for _, t in got(spark.createDataFrame(rows, "doc_id long, text string"))]
    first = min((hashlib.md5(f"1\n{t}".encode()).digest(), t) for _, t in rows)[1]
    assert sorted(texts) == sorted(t if t == first else t.split("\n")[0] for _, t in rows)


def test_runs_that_only_later_documents_share_go_too(spark):
    r, m, t = ([f"{c}{i} " + " ".join(f"{c}{i}x{j}" for j in range(11)) for i in range(2)] for c in "rmt")
    rows = [(1, "\n".join(["a b c", *m, "d e f"])), (2, "\n".join([*r, *m, *t])), (3, "\n".join(["g h i", *r, *m, *t, "j k l"]))]
    kept = dict(got(spark.createDataFrame(rows, "doc_id string, text string")))
    assert kept["2"] == "\n".join([*r, *t]) and kept["3"] == "g h i\nj k l"


def test_odd_rows(odd, nothing):
    check(odd)
    assert got(nothing) == []
    assert len(got(odd)) == odd.count()
