"""4. Suffix-array deduplication of 50-byte strings, by deep-shallow sorting.

A byte goes if it lies in a string of SPAN bytes that also starts in a document with a smaller doc_id. Suffixes need
sorting only among those that can be equal, so they are dealt by content first: each SPAN-byte window names the smallest
hash of its GRAM-byte substrings, equal windows name the same one, and a window whose name occurs in one text alone is
unique. Steps:

1. anchors: the named places of every text, about one in 14 bytes; their keys go out as sorted, delta-coded arrays, and
   keys met in two different texts come back to the texts that have them (a false match only costs a comparison);
2. contexts: around each such place, the bytes of all windows that name it, dealt by key;
3. each task puts the windows of its contexts into suffix order by deep-shallow sorting: multikey quicksort by machine
   words down to SHALLOW bytes, then for each group that is still equal a blind trie, whose nodes hold only where their
   suffixes first differ and branch by that byte. Windows equal to the end form a class, whose smallest doc_id decides;
4. spans found are united per text and cut out.

Both sorts run over all groups of a task at once, one level of quicksort or of the tries after the other.

Equal texts count as one text with their smallest doc_id from the start; further copies go whole. A key that more than
HOT texts are told of (a phrase in a large share of all rows) is known before contexts are dealt. Its contexts are dealt by
their place and not sorted: the different ones are cut into windows, which are dealt by their own bytes and take the
smallest doc_id by an aggregation with partial results. Both ways are exact. Of the hot keys 8 bytes each are broadcast; one
stands for over HOT contexts of about 100 bytes.

Defined results: a null or empty text has no bytes; a null doc_id comes after all others; rows with equal doc_id never
remove bytes of each other; repeated rows give repeated results; an empty table gives no rows. doc_id has to be a number
(other values that do not read as one count as null).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import documents, joined, released, slices, squeezed, stored, table, unsqueezed

SPAN, GRAM, SHALLOW = 50, 24, 16
WIDE = SPAN - GRAM + 1
HOT = 200_000
#: Texts of one part that are told of a key, from which on the part counts it among those that may be hot.
OFTEN = 16
#: Contexts sorted together, and anchors sent together.
BLOCK, FLUSH = 8_000, 750_000
LAST = 2**63 - 1
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on, by doubling: 1, 2, 4, 8, 16 bytes, then 16 + 8."""
    h, kept, w = _BYTE[data], {}, 1
    while w < 16:
        h = h[: max(0, len(h) - w)] * _U(pow(_BASE, w, 1 << 64)) + h[w:]
        w *= 2
        kept[w] = h
    n = max(0, len(data) - GRAM + 1)
    return _mixed(kept[16][:n] * _U(pow(_BASE, 8, 1 << 64)) + kept[8][16 : 16 + n])


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    s = 1
    while 2 * s <= width:
        a = pick(a[:-s], a[s:])
        s *= 2
    return pick(a[: len(a) - (width - s)], a[width - s :]) if s < width else a


class Anchors:
    """The named places of a list of texts: ``at`` in the joined ``data``, ``doc``, ``key``."""

    def __init__(self, texts: list[bytes]):
        lens = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lens)
        self.begins = self.ends - lens
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.at = self.doc = np.zeros(0, np.int64)
        self.name = self.key = np.zeros(0, np.uint64)
        if len(self.data) < SPAN:
            return
        h = gram_hashes(self.data)
        least = _sliding(h, WIDE, np.minimum)  # of the window that starts here
        over = np.zeros(len(self.data) + 1, np.int32)  # windows that would cross the end of a text
        np.add.at(over, np.maximum(self.ends - SPAN + 1, self.begins), 1)
        np.add.at(over, self.ends, -1)
        self.least = np.where(np.cumsum(over)[: len(least)] > 0, _U(0), least)
        edge = np.zeros(WIDE - 1, np.uint64)
        self.at = np.flatnonzero(_sliding(np.concatenate([edge, self.least, edge]), WIDE, np.maximum)[: len(h)] == h)
        self.name = h[self.at]
        self.key = _mixed(self.name)  # names are small, being minima; keys are spread evenly
        self.doc = np.searchsorted(self.ends, self.at, "right")

    def windows(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows that name each of these places."""
        at, name = self.at[pick], self.name[pick]
        first, last = at.copy(), np.maximum(at - WIDE, -1)
        for back in range(WIDE):
            s = at - back
            ok = (s >= 0) & (s < len(self.least))
            ok[ok] = self.least[s[ok]] == name[ok]
            first[ok] = s[ok]
            last = np.where(ok & (last < s), s, last)
        return first, last


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that high zero bytes compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(b: bytes, kind: type) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(n, -1).T).view(kind).ravel()


def _ranges(firsts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each, one after the other."""
    offs = np.cumsum(lens) - lens
    return np.repeat(firsts - offs, lens) + np.arange(lens.sum())


def _binaries(data: np.ndarray, firsts: np.ndarray, lens: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lens) + 1, np.int32)
    np.cumsum(lens, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(data[_ranges(firsts, lens)])])


SENT = "part int, sure boolean, keys binary, who binary, k1 binary, k2 binary"


def _sent(parts: int, bits: int):
    """Mapper of step 1: anchor keys by part of the key space. ``sure`` rows hold keys known to be shared already."""

    def flush(keys: np.ndarray, who: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
        _, rep, same = np.unique(k1, return_index=True, return_inverse=True)  # equal texts are one
        who = rep[same].astype(np.int32)[who]
        k1, k2 = np.append(k1, _U(0)), np.append(k2, _U(0))  # the last stands for several texts
        order = np.lexsort((who, keys))
        keys, who = keys[order], who[order]
        fresh = np.r_[True, (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])]
        keys, who = keys[fresh], who[fresh]
        begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        times = np.diff(np.r_[begins, len(keys)])
        many = np.repeat(times > 1, times)
        rows: list[tuple] = []

        def add(k: np.ndarray, w: np.ndarray, sure: bool, part: np.ndarray) -> None:
            o = np.lexsort((k, part))
            k, w, part = k[o], w[o], part[o]
            for a, b in zip(x := np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), [*x[1:], len(part)], strict=True):
                used, own = np.unique(w[a:b], return_inverse=True)
                delta = np.diff(k[a:b], prepend=_U(0))
                rows.append((int(part[a]), sure, _planes(delta), _planes(own.astype(np.uint32)), k1[used].tobytes(), k2[used].tobytes()))

        if many.any():  # these texts know; for others one entry tells
            add(keys[many], who[many], True, (k1[who[many]] % _U(parts)).astype(np.int64))
        one = np.ones(len(keys), bool)
        one[many] = False
        one[begins] = True
        add(keys[one], np.where(times > 1, len(k1) - 1, who[begins]), False, (keys[one] >> _U(bits - 32)).astype(np.int64) * parts >> 32)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), *[pa.binary()] * 4), strict=True)], names=["part", "sure", "keys", "who", "k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, who, k1, k2, n, docs = [], [], [], [], 0, 0

        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                a = Anchors([t.encode() for t in part.column("text").to_pylist()])
                keys.append(a.key >> _U(64 - bits))
                who.append((a.doc + docs).astype(np.int32))
                k1.append(part.column("k1").to_numpy().view(np.uint64))
                k2.append(part.column("k2").to_numpy().view(np.uint64))
                docs += part.num_rows
                n += len(a.key)
                if n >= FLUSH:
                    yield flush(*map(np.concatenate, (keys, who, k1, k2)))
                    keys, who, k1, k2, n, docs = [], [], [], [], 0, 0
        if n:
            yield flush(*map(np.concatenate, (keys, who, k1, k2)))
        del keys, who, k1, k2
        released()

    return run


TOLD = "k1 long, k2 long, keys binary, often binary"


def _told(table_: pa.Table) -> pa.Table:
    """Reducer of step 1: k1, k2, keys for the texts that have a key of this part which other texts have too.

    One row more has ``often``: pairs of a key and how many texts it is told to here.
    """
    released()
    texts, keys, who, sure = [], [], [], []
    n = 0
    for row in (r for b in table_.to_batches(max_chunksize=64) for r in b.to_pylist()):
        k = np.cumsum(_unplaned(row["keys"], np.uint64))
        own = np.frombuffer(row["k1"], np.uint64), np.frombuffer(row["k2"], np.uint64)
        texts.append(own)
        keys.append(k)
        who.append((_unplaned(row["who"], np.uint32) + np.uint32(n)).astype(np.int32))
        sure.append(np.full(len(k), row["sure"]))
        n += len(own[0])
    k1, k2 = (np.concatenate(x) for x in zip(*texts, strict=True))
    keys, who, sure = np.concatenate(keys), np.concatenate(who), np.concatenate(sure)
    _, same = np.unique(k1, return_inverse=True)
    same = same.astype(np.int32)
    order = np.flatnonzero(~sure)
    order = order[np.argsort(keys[order])].astype(np.int32)
    shared = np.zeros(len(order), bool)
    if len(order):
        k = keys[order]
        begins = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        del k
        w = same[who[order]]
        many = np.maximum.reduceat((k1 == 0)[who[order]], begins)  # the stand-in for several texts of one mapper
        shared = np.repeat((np.minimum.reduceat(w, begins) != np.maximum.reduceat(w, begins)) | many, np.diff(np.r_[begins, len(order)]))
        del w
    tell = np.r_[np.flatnonzero(sure).astype(np.int32), order[shared]]
    tell = tell[k1[who[tell]] != 0]
    del order, shared, sure
    often = np.sort(keys[tell])
    edges = np.flatnonzero(np.r_[True, often[1:] != often[:-1], True][: len(often) + 1])
    many = np.diff(edges) >= OFTEN
    often = np.stack([often[edges[:-1][many]], np.diff(edges)[many].astype(np.uint64)], 1).tobytes()
    tell = tell[np.argsort(same[who[tell]], kind="stable")]
    w = same[who[tell]]
    begins = np.flatnonzero(np.r_[True, w[1:] != w[:-1]][: len(w)])
    first = who[tell][begins]
    lens = np.diff(np.r_[begins, len(w)]) * 8
    found = np.frombuffer(keys[tell].tobytes(), np.uint8)
    columns = [pa.array(k1[first].view(np.int64)), pa.array(k2[first].view(np.int64)), _binaries(found, begins * 8, lens)]
    columns = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in columns]
    return pa.table([*columns, pa.array([None] * len(first) + [often], pa.binary())], names=["k1", "k2", "keys", "often"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mapper: key, n of the pairs in ``often``."""
    for batch in batches:
        pairs = np.frombuffer(b"".join(batch.column("often").to_pylist()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["short", "n"])


def _contexts(bits: int):
    """Mapper of step 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                a = Anchors(unsqueezed(part.column("text")))
                told = [np.concatenate([np.frombuffer(b, np.uint64) for b in x]) for x in part.column("told").to_pylist()]
                salt = np.arange(part.num_rows, dtype=np.uint64) * _U(_BASE)
                want = np.concatenate([_mixed(x + s) for x, s in zip(told, salt, strict=True)])
                pick = np.flatnonzero(np.isin(_mixed((a.key >> _U(64 - bits)) + salt[a.doc]), want)) if len(a.key) else np.zeros(0, np.int64)
                if not len(pick):
                    continue
                first, last = a.windows(pick)
                doc = pa.array(a.doc[pick])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a.key[pick].view(np.int64)),
                        pa.array((a.key[pick] >> _U(64 - bits)).view(np.int64)),
                        _binaries(a.data, first, last - first + SPAN),
                        *(part.column(c).take(doc) for c in ("id", "k1")),
                        pa.array(first - a.begins[a.doc[pick]]),
                    ],
                    names=["key", "short", "bytes", "id", "k1", "start"],
                )
        released()

    return run


def suffix_classes(rows: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sorting of all SPAN-byte windows of these strings (one to a row, zero-padded).

    Returns for each string the number of its first window, and for each window the smallest id among equal windows.
    """
    n = lens - SPAN + 1
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(rows)), n)
    start = _ranges(np.zeros(len(rows), np.int64), n)
    width = rows.shape[1]
    flat = np.concatenate([rows.ravel(), np.zeros(8, np.uint8)])
    word = np.zeros(len(flat) - 8, np.uint64)  # the eight bytes from each place on, as a number
    for i in range(8):
        word = (word << _U(8)) | flat[i : i + len(word)]
    place = row * width + start
    order = np.arange(len(place))
    new = _quicksorted(word, place, order)
    _tried(flat, word, place, order, new)
    begins = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[row[order]], begins)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[begins, len(order)]))
    return first, out


def _groups(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the groups of more than one member."""
    begins = np.flatnonzero(new)
    ends = np.r_[begins[1:], len(new)]
    many = ends - begins > 1
    return begins[many], ends[many]


def _quicksorted(word: np.ndarray, place: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Multikey quicksort of ``order`` by the first SHALLOW bytes, eight at a time; returns where groups begin.

    Each round splits every group around its own pivot (the median of three): smaller ones, equal ones, which go on with
    their next word, and larger ones.
    """
    new = np.zeros(len(order), bool)
    new[:1] = True
    begins, ends = _groups(new)
    depth = np.zeros(len(begins), np.int64)
    while len(begins):
        size = ends - begins
        off = np.cumsum(size) - size
        group = np.repeat(np.arange(len(size)), size)
        at = _ranges(begins, size)
        own = order[at]
        w = word[place[own] + depth[group]]
        a, b, c = w[off], w[off + size // 2], w[off + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        less, same = w < pivot, w == pivot
        n_less, n_same = np.add.reduceat(less, off, dtype=np.int64), np.add.reduceat(same, off, dtype=np.int64)
        del w, pivot
        to = np.empty(len(at), np.int64)
        for mask, first in ((less, begins), (same, begins + n_less), (~(less | same), begins + n_less + n_same)):
            of = group[mask]
            nth = np.arange(len(of)) - np.searchsorted(of, np.arange(len(size)))[of]
            to[mask] = first[of] + nth
        order[to] = own
        at = np.stack([begins, begins + n_less, begins + n_less + n_same, ends], 1)
        new[at[:, 1][n_less > 0]] = True
        new[at[:, 2][at[:, 2] < ends]] = True
        deeper = np.stack([depth, depth + 8, depth], 1).ravel()
        begins, ends = at[:, :3].ravel(), at[:, 1:].ravel()
        on = (ends - begins > 1) & (deeper < SHALLOW)
        begins, ends, depth = begins[on], ends[on], deeper[on]
    return new


def _tried(flat: np.ndarray, word: np.ndarray, place: np.ndarray, order: np.ndarray, new: np.ndarray) -> None:
    """Blind tries of all groups that are equal in SHALLOW bytes, a level in each round; sorts ``order``, marks ``new``."""
    begins, ends = _groups(new)
    while len(begins):
        size = ends - begins
        off = np.cumsum(size) - size
        group = np.repeat(np.arange(len(size)), size)
        at = _ranges(begins, size)
        own = place[order[at]]
        leader = own[off][group]
        differs = np.full(len(at), SPAN, np.int64)
        for s in (SPAN - 8, *range((SPAN - 9) // 8 * 8, SHALLOW - 1, -8)):
            x = word[own + s] ^ word[leader + s]
            odd = np.flatnonzero(x)
            differs[odd] = s + sum((x[odd] >> _U(64 - 8 * i) == 0).astype(np.int64) for i in range(1, 8))
        skip = np.minimum.reduceat(differs, off)  # where the node branches
        on = (skip < SPAN)[group]
        at, own, group = at[on], own[on], group[on]
        branch = group * 256 + flat[own + skip[group]]
        o = np.argsort(branch, kind="stable")
        order[at] = order[at][o]
        branch = branch[o]
        fresh = np.r_[True, branch[1:] != branch[:-1]][: len(branch)]
        new[at[fresh]] = True
        first = np.flatnonzero(fresh)
        n = np.diff(np.r_[first, len(branch)])
        begins = at[first][n > 1]
        ends = begins + n[n > 1]


FOUND = "k1 long, id long, spans binary, bytes binary, start long"


def _spans(k1: np.ndarray, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row for each text (by hash and smallest doc_id): its spans as pairs of 64-bit numbers."""
    order = np.lexsort((begin, ids, k1))
    k1, ids = k1[order], ids[order]
    pairs = np.stack([begin[order], end[order]], 1)
    begins = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (ids[1:] != ids[:-1])])
    lens = np.diff(np.r_[begins, len(k1)]) * 16
    none = lambda t: pa.nulls(len(begins), t)
    return pa.RecordBatch.from_arrays(
        [pa.array(k1[begins]), pa.array(ids[begins]), _binaries(np.frombuffer(pairs.astype(np.int64).tobytes(), np.uint8), begins * 16, lens), none(pa.binary()), none(pa.int64())],
        names=["k1", "id", "spans", "bytes", "start"],
    )


def _block(t: pa.Table) -> pa.RecordBatch | None:
    """The spans to remove that these contexts show."""
    texts = t.column("bytes").combine_chunks().dictionary_encode()
    of = texts.indices.to_numpy()
    ids = t.column("id").to_numpy()
    strings = texts.dictionary
    lens = np.diff(np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]).astype(np.int64)
    width = int(lens.max())
    rows = np.zeros((len(lens), width), np.uint8)
    rows[np.repeat(np.arange(len(lens)), lens), _ranges(np.zeros(len(lens), np.int64), lens)] = np.frombuffer(b"".join(strings.to_pylist()), np.uint8)
    least_id = np.full(len(lens), LAST)
    np.minimum.at(least_id, of, ids)
    first, least = suffix_classes(rows, lens, least_id)
    n = (lens - SPAN + 1)[of]
    row = np.repeat(np.arange(len(of)), n)
    window = _ranges(first[of], n)
    gone = least[window] < ids[row]
    row, s = row[gone], (window - first[of[row]])[gone]
    return _runs(row, s, t) if len(row) else None


def _runs(row: np.ndarray, s: np.ndarray, t: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
    """Windows s of the contexts t[row], in order, as spans of their texts."""
    fresh = np.r_[True, (row[1:] != row[:-1]) | (s[1:] != s[:-1] + 1)]
    ends = np.r_[np.flatnonzero(fresh)[1:], len(row)] - 1
    r = row[fresh]
    start = t.column("start").to_numpy()[r]
    return _spans(t.column("k1").to_numpy()[r], t.column("id").to_numpy()[r], start + s[fresh], start + s[ends] + SPAN)


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 over contexts in key order; those of hot keys go on as they are, batch by batch."""
    held: list[pa.RecordBatch] = []
    n = 0

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if (b := _block(t)) is not None:
            yield b

    for batch in batches:
        hot = batch.column("hot").to_numpy(zero_copy_only=False)
        if hot.any():
            h = batch.filter(pa.array(hot))
            names = ["k1", "id", "spans", "bytes", "start"]
            yield pa.RecordBatch.from_arrays([pa.nulls(h.num_rows, pa.binary()) if c == "spans" else h.column(c) for c in names], names=names)
            batch = batch.filter(pa.array(~hot))
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= BLOCK:
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
            if cut:
                for a in _parts(key[:cut]):
                    yield from done(t.slice(a[0], a[1] - a[0]))
                held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        t = pa.Table.from_batches(held)
        for a in _parts(t.column("key").to_numpy()):
            yield from done(t.slice(a[0], a[1] - a[0]))
        del t, held
    released()


def _parts(key: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of about BLOCK rows that end where a key ends."""
    ends = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    out, a = [], 0
    while a < len(key):
        b = int(ends[min(np.searchsorted(ends, a + BLOCK, "left"), len(ends) - 1)])
        out.append((a, b))
        a = b
    return out


def _united(spans: list[np.ndarray]) -> np.ndarray:
    """Maximal runs covered by [begin, end) pairs."""
    x = np.concatenate([np.frombuffer(b, np.int64) for b in spans]).reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    reach = np.maximum.accumulate(x[:, 1])
    fresh = np.r_[True, x[1:, 0] > reach[:-1]]
    return np.stack([x[fresh, 0], reach[np.r_[np.flatnonzero(fresh)[1:] - 1, len(x) - 1]]], 1)


def _named(docs: DataFrame, seeds: int = 16) -> DataFrame:
    """Rows with (k1, k2), the 128-bit name of their text, of which k1 is checked to name it alone.

    Step 1 and contexts carry k1 and not k2. Where two texts share a k1, other seeds are taken; where texts are so many
    (billions) that some always do, k1 and the smallest ``own`` of a text must be its own, which is what spans are joined by.
    """
    for i in range(seeds):
        named = docs.withColumn("k1", F.xxhash64(F.lit(2 * i), "text")).withColumn("k2", F.xxhash64(F.lit(2 * i + 1), "text"))
        names = named.groupBy("k1", "k2").agg(F.min("own").alias("own"))
        if names.groupBy("k1", *["own"] * (i > 3)).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return named
    raise ValueError("no seed tells the texts apart")


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, text (zstd), spans (list of binary: [begin, end) pairs of bytes to remove, may overlap), copy (goes whole)."""
    parts = docs.rdd.getNumPartitions() + 8  # the number alone
    bits = min(64, 36 + math.ceil(math.log2(parts)))
    n = F.coalesce(F.col("doc_id").try_cast("long"), F.lit(LAST))
    docs = _named(documents(docs).withColumn("own", n))
    least = docs.groupBy("k1", "k2").agg(F.min("own").alias("id"))
    sent = docs.select("k1", "k2", "text").mapInArrow(_sent(parts, bits), SENT).groupBy("part").applyInArrow(_told, TOLD)
    told = sent.where("keys is not null").groupBy("k1", "k2").agg(F.collect_list("keys").alias("told"))
    often = sent.where("often is not null").select("often").mapInArrow(_counted, "short long, n long").groupBy("short").agg(F.sum("n").alias("n"))
    owners = least.withColumnRenamed("id", "own")
    # Copies of a text are dealt by their doc_id too. Both joins of the texts keep the same columns, to read one shuffle.
    texts = squeezed(docs.select("doc_id", "text", "k1", "k2", "own"))
    shape = "key long not null, short long not null, bytes binary, id long, k1 long, start long"
    met = texts.join(owners.join(told, ["k1", "k2"]), ["k1", "k2", "own"])
    contexts = met.select("doc_id", "text", F.col("own").alias("id"), "k1", "k2", "told").mapInArrow(_contexts(bits), shape)
    hottest = often.where(F.col("n") > hot).select("short", F.lit(True).alias("hot"))
    flagged = contexts.join(F.broadcast(hottest), "short", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).drop("short")
    salt = F.when(F.col("hot"), F.xxhash64("k1", "start")).otherwise(0)
    found = stored(flagged.repartition("key", salt).sortWithinPartitions("key").mapInArrow(_sorted, FOUND), "suffixes")
    pairs = _hot_spans(found.where("bytes is not null"))
    spans = found.where("spans is not null").select("k1", "id", "spans").union(pairs).groupBy("k1", F.col("id").alias("own")).agg(F.collect_list("spans").alias("spans"))
    known = owners.join(spans, ["k1", "own"], "left").withColumn("copy", F.lit(False))
    return texts.join(known, ["k1", "k2", "own"], "left").select("doc_id", "text", "spans", F.coalesce("copy", F.lit(True)).alias("copy"))


def _hot_spans(contexts: DataFrame) -> DataFrame:
    """Step 3 for the contexts of hot keys: k1, id, spans. Different contexts are cut into windows once."""
    least = stored(contexts.groupBy("bytes").agg(F.min("id").alias("id"), F.count("*").alias("n")), "hot")
    if least.isEmpty():
        return contexts.select("k1", "id", "spans").where("false")
    cut = F.transform(F.sequence(F.lit(0), F.length("bytes") - SPAN), lambda i: F.substring("bytes", i + 1, F.lit(SPAN)))
    windows = stored(least.select("bytes", "id", F.posexplode(cut).alias("at", "window")), "windows")
    first = stored(windows.groupBy("window").agg(F.min("id").alias("least"), F.count("*").alias("n")), "firsts")
    placed = joined(windows, first, "window").groupBy("bytes").agg(F.array_sort(F.collect_list(F.struct("at", "least"))).alias("x"))
    known = stored(placed.select("bytes", F.col("x.least").alias("least")), "least")
    return joined(contexts.drop("spans"), known, "bytes", sizes=least).select("k1", "id", "start", "least").mapInArrow(_cut_hot, "k1 long, id long, spans binary")


def _cut_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = batch.column("least")
        n = least.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        gone = least.flatten().to_numpy() < batch.column("id").to_numpy()[row]
        at = _ranges(np.zeros(len(n), np.int64), n)[gone]
        if len(at):
            yield _runs(row[gone], at, batch).select(["k1", "id", "spans"])


def removed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay)."""
    return _cut(docs, hot, "kept binary", lambda b: b)


def _cut(docs: DataFrame, hot: int, last: str, made) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 19)):
            rows = []
            for b, spans, copy in zip(unsqueezed(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                runs = [(0, len(b))] if copy and len(b) >= SPAN else _united(spans).tolist() if spans and not copy else []
                at = [0, *[x for r in runs for x in r], len(b)]
                rest = b"".join(b[i:j] for i, j in zip(at[::2], at[1::2], strict=True))
                rows.append((len(b), len(b) - len(rest), len(runs), made(rest)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0]])
        released()

    return repeated_spans(docs, hot).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {last}")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(table(spark, sf_dir, "documents"), HOT, "kept_sha256 string", lambda b: hashlib.sha256(b).hexdigest())
