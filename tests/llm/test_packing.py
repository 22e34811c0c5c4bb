from __future__ import annotations

import zlib

import numpy as np
from tokenizers import Tokenizer

from kgspark.llm.common import tokenizer_path
from kgspark.llm.packing import CAPACITY, fullest, pack, plan


def held(rows, texts):
    """Each document's pieces give its ids again, and each sequence is gapless and within capacity."""
    library = Tokenizer.from_file(tokenizer_path())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by[doc_id], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), CAPACITY))
        for r in own:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert sum(r.length for r in own) == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= CAPACITY
    return len(sequences)


def test_all_documents_lie_in_nearly_the_fewest_sequences(docs, texts):
    rows = pack(docs).collect()
    n = held(rows, texts)
    assert n <= -(-sum(r.length for r in rows) // CAPACITY) + 2


def test_fullest_is_the_largest_sum():
    counts = {900: 1, 700: 2, 300: 3, 5: 1}
    used = fullest(counts, sorted(counts, reverse=True), 1148)
    assert sum(n * k for n, k in used.items()) == 1005  # 700 + 300 + 5
    assert fullest(counts, sorted(counts, reverse=True), 4) == {}


def test_plan_places_every_piece_once():
    histogram = {2048: 3, 1000: 5, 600: 7, 48: 9, 1: 4}
    seen = {n: set() for n in histogram}
    fill = {}
    for n, low, high, first, copies, _ in plan(histogram):
        for rank in range(low, high):
            assert rank not in seen[n]
            seen[n].add(rank)
            s = first + (rank - low) // copies
            fill[s] = fill.get(s, 0) + n
    assert {n: len(x) for n, x in seen.items()} == histogram
    assert max(fill.values()) <= CAPACITY


def test_odd_rows(odd, nothing):
    rows = pack(odd).collect()
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert [r.length for r in rows if r.doc_id == 3] == [1]
    assert len({(r.sequence_id, r.offset) for r in rows if r.doc_id == 8}) == 2
    assert pack(nothing).collect() == []
