"""10. BPE encoding and decoding with content-defined chunk reuse.

A gear rolling hash cuts every text into chunks at places that depend on nearby bytes alone, so copies and shared
passages give equal chunks wherever they stand. A first pass counts chunk hashes; chunks seen more than once are encoded
once, from the text of one owner, and their ids travel to every document that has them. All other chunks are encoded
where they are met. A cut may fall inside a word, which changes its tokens: at each seam the text around it is encoded
again as one, over a wider stretch until the outer words' ids agree with what the chunks have.

Only hashes, the shared chunks and one shuffle of the texts are moved, and no key gathers rows: a chunk that a third of
the documents hold is one row of the shared table, and as a hot key it is broadcast to its (document, hash) rows.

Defined results: a null or empty text has no ids and decodes to ''; null doc_ids and repeated rows are encoded as rows of
their own; special tokens' strings in a text become special tokens, as the library has it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import WordEncoder, documents, joined, slices, squeezed, stored, table, tokenizer_path, unsqueezed

#: Chunks are 2**BITS bytes long on average; the rolling hash sees WINDOW bytes.
BITS, WINDOW = 9, 32
_mix = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_mix ^= _mix >> np.uint64(29)
GEAR = ((_mix * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)
SPACES = frozenset(b" \t\n\x0b\x0c\r")


def cuts(texts: list[bytes], bits: int = BITS) -> list[list[int]]:
    """Inner chunk borders of each text: byte offsets, never inside a character."""
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, w = GEAR[data], 1
    while w < WINDOW:  # sums of GEAR over w bytes, the older ones shifted
        older = h[:-w] << np.uint32(w)
        h[w:] += older
        w *= 2
    hit = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    hit = hit[hit < len(data)]
    hit = hit[(data[hit] & 0xC0) != 0x80]
    of = np.searchsorted(ends, hit, "right")
    begins = ends - [len(t) for t in texts]
    at = hit - begins[of]
    keep = at >= WINDOW  # a full window inside the text itself
    of, at = of[keep], at[keep]
    split = np.searchsorted(of, np.arange(1, len(texts)))
    return [x.tolist() for x in np.split(at, split)]


def chunks(text: bytes, borders: list[int]) -> list[bytes]:
    at = [0, *borders, len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)] if text else []


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def repaired(encoder: WordEncoder, parts: list[bytes], ids: list[bytes]) -> bytes:
    """The ids of the whole text from those of its chunks.

    Around every seam inside a word, the text from some words before to some words after it is encoded as one; where the
    outer words come out with the ids that the chunks have, that stands in for the seam, else the stretch is widened.
    """
    out: list[bytes] = []
    known, ahead = parts[0], ids[0]  # the last stretch and its ids
    for part, own in zip(parts[1:], ids[1:], strict=True):
        if known[-1] in SPACES or part[0] in SPACES:
            out.append(ahead)
            known, ahead = part, own
            continue
        width = 2
        while True:
            left, right = known.rsplit(None, width)[-width:], part.split(None, width)[:width]
            begin, end = _before(known, left), _after(part, right)
            again = encoder.whole(known[begin:] + part[:end])
            lead, tail = (b"".join(map(encoder.encode, x)) for x in (left[:-1], right[1:]))
            last, first = encoder.encode(left[-1]), encoder.encode(right[0])
            if ahead.endswith(lead + last) and own.startswith(first + tail) and again.startswith(lead) and again.endswith(tail):
                out.append(ahead[: len(ahead) - len(lead) - len(last)])
                known, ahead = known[begin:] + part, again + own[len(first) + len(tail) :]
                break
            if len(left) < width and len(right) < width:  # both chunks are in the stretch
                known, ahead = known + part, encoder.whole(known + part)
                break
            width *= 2
    out.append(ahead)
    return b"".join(out)


def _before(known: bytes, words: list[bytes]) -> int:
    at = len(known)
    for w in reversed(words):
        at = known.rindex(w, 0, at)
    return at


def _after(part: bytes, words: list[bytes]) -> int:
    at = 0
    for w in words:
        at = part.index(w, at) + len(w)
    return at


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key for their text; a key that two texts happen to share only joins their lists of chunks."""
    return documents(docs).withColumn("key", F.xxhash64("doc_id", "text"))


def chunk_hashes(docs: DataFrame) -> DataFrame:
    """key, hash: one row for each different chunk of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t.encode() for t in part.column("text").to_pylist()]
                of, found = [], []
                for i, (text, borders) in enumerate(zip(texts, cuts(texts), strict=True)):
                    own = {digest(c) for c in chunks(text, borders)}
                    of += [i] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(of, pa.int32())), pa.array(found, pa.binary())], names=["key", "hash"])

    return docs.select("key", "text").mapInArrow(run, "key long, hash binary")


def encoded_once(owners: DataFrame, path: str) -> DataFrame:
    """hash, ids (zlib) of the chunks named in ``wanted`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = unsqueezed(part.column("text"))
                out: dict[bytes, bytes] = {}
                for text, borders, wanted in zip(texts, cuts(texts), part.column("wanted").to_pylist(), strict=True):
                    names = set(wanted)
                    for c in chunks(text, borders):
                        if (h := digest(c)) in names and h not in out:
                            out[h] = zlib.compress(encoder.encode(c), 1)
                yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.binary())], names=["hash", "ids"])

    return owners.select("doc_id", "text", "wanted").mapInArrow(run, "hash binary, ids binary")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), decoded string for each row."""
    return _assembled(docs, path, "ids binary, decoded string", lambda ids, text: (ids, text))


def _assembled(docs: DataFrame, path: str | None, result: str, made) -> DataFrame:
    path = path or tokenizer_path()
    docs = keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(chunk_hashes(docs), "chunks")
    shared = stored(found.groupBy("hash").agg(F.count("*").alias("n"), F.min("key").alias("owner")).where("n > 1"), "shared")
    wanted = shared.groupBy(F.col("owner").alias("key")).agg(F.collect_list("hash").alias("wanted"))
    # This join and the last one read the same shuffle of the texts, so both keep the same columns.
    texts = squeezed(docs)
    once = encoded_once(texts.join(wanted, "key"), path).groupBy("hash").agg(F.first("ids").alias("ids"))
    # A set: repeated rows have one key, and each of them needs the chunks of its text once.
    lists = joined(found, once, "hash", sizes=shared).groupBy("key").agg(F.collect_set(F.struct("hash", "ids")).alias("have"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = unsqueezed(part.column("text"))
                rows = []
                for text, borders, have in zip(texts, cuts(texts), part.column("have").to_pylist(), strict=True):
                    ready = {x["hash"]: zlib.decompress(x["ids"]) for x in have or ()}
                    parts = chunks(text, borders)
                    ids = [ready.get(digest(c)) if ready else None for c in parts]
                    ids = [encoder.encode(c) if x is None else x for c, x in zip(parts, ids, strict=True)]
                    whole = repaired(encoder, parts, ids) if parts else b""
                    rows.append(made(whole, encoder.decode(whole)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, zip(*rows, strict=True))], names=["doc_id", *[x.split()[0] for x in result.split(", ")]])

    return texts.join(lists, "key", "left").select("doc_id", "text", "have").mapInArrow(run, f"doc_id {kind}, {result}")


def op10_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(ids: bytes, text: str) -> tuple[int, str, str]:
        return len(ids) >> 2, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _assembled(table(spark, sf_dir, "documents"), None, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
