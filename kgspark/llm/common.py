"""What the pipeline operators share: table access, words, shared tables and the word-cached tokenizer."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; words are the runs of everything else.
SPACE = "[\\x20\\x09-\\x0D]+"
TRIM = " \t\n\u000b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *keep: str) -> DataFrame:
    """The columns an operator reads, so that further columns of the caller cannot clash with its own."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)


def words(text: Column) -> Column:
    """array<string> of the words of a text; empty for null, empty or blank texts."""
    bare = F.trim(text, F.lit(TRIM))
    return F.when(F.length(bare) > 0, F.split(bare, SPACE)).otherwise(F.array().cast("array<string>"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of this session where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='kgspark-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where


def where_column(df: DataFrame, column: str) -> DataFrame:
    """Rows whose boolean ``column`` is true, where its expression is large.

    The optimizer moves filters below projections by copying expressions into them, once for every mention; it leaves
    filters above a column that is not deterministic.
    """
    return df.withColumn("_row", F.monotonically_increasing_id()).where(F.col(column) & (F.col("_row") >= 0)).drop("_row")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys of more than one part in SHARES of all rows count as hot; there are fewer of them than SHARES.
SHARES = 1024


def joined(rows: DataFrame, one: DataFrame, *key: str, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``one``, which has one row for each key.

    ``n`` in ``sizes`` (or in ``one``, which drops it) is how often ``rows`` has a key. Rows of hot keys stay where they are
    and meet the broadcast rows of ``one``, of which there are fewer than SHARES at any size of the data; only the others
    are shuffled. Give stored tables, as they are read more than once.
    """
    keys = [*key]
    sizes, one = (one if sizes is None else sizes), (one.drop("n") if sizes is None else one)
    size = sizes.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    if not size.total or size.most * SHARES <= size.total:
        return rows.join(one, keys, how)
    hot = F.broadcast(sizes.where(F.col("n") * SHARES > size.total).select(keys))
    spread = rows.join(F.broadcast(one.join(hot, keys, "left_semi")), keys)
    return spread.unionByName(rows.join(hot, keys, "left_anti").join(one.join(hot, keys, "left_anti"), keys, how))


def released() -> None:
    """Give freed memory back at the end of a task: Python workers are reused, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows and, but for a longer single row, ``most`` bytes of ``column``."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and (total + n > most or i - at == rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def squeezed(df: DataFrame) -> DataFrame:
    """``df`` with its column text compressed (zstd, binary), to be shuffled at less than half the size."""
    fields = [T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType, f.nullable) for f in df.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            cols = [pa.array([squeeze(t.encode()) for t in c.to_pylist()], pa.binary()) if f.name == "text" else c for f, c in zip(fields, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])
        released()

    return df.mapInArrow(run, T.StructType(fields))


def unsqueezed(column: pa.Array) -> list[bytes]:
    return list(map(zstandard.ZstdDecompressor().decompress, column.to_pylist()))


def restored(df: DataFrame) -> DataFrame:
    """The inverse of ``squeezed``."""
    fields = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType, f.nullable) for f in df.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [pa.array([b.decode() for b in unsqueezed(c)], pa.string()) if f.name == "text" else c for f, c in zip(fields, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words of one script run and at most one closing mark: such a word is a single pre-token (and the mark another).
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-į]+)([.,]?)")


class Known(dict):
    """A dictionary that makes missing values, emptied when it has ``limit`` entries."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Encodes byte strings as the tokenizers library does, word by word.

    The vocabulary's pre-tokenizer never joins across ASCII white space, so a text's ids are the ids of its words in
    turn. Words are kept in dictionaries of at most ``limit`` entries, which are emptied when full; that only saves time.
    """

    _open: dict[str, WordEncoder] = {}

    def __init__(self, path: str, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = Known(self._word, limit)
        self.letters = Known(self._letters, limit)
        self.marks = {m: self._ids(m) for m in ("", ".", ",")}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE's printable bytes
        hidden = [b for b in range(256) if b not in visible]
        self.chars = [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]
        self.pieces = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder for each Python worker."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _ids(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not (m := PLAIN.fullmatch(text)):
            return self._ids(text)
        return self.letters[m[1].lower()] + self.marks[m[2]]

    def _letters(self, low: str) -> bytes:
        chars = low if low.isascii() else "".join([self.chars[b] for b in low.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(chars)])

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, text.split()))

    def whole(self, text: bytes) -> bytes:
        """The same ids by one call of the library over the text."""
        return self._ids(text.decode())

    def decode(self, ids: bytes) -> str:
        """decode(ids, skip_special_tokens=False) of a tokenizer without a decoder: its tokens, spaced."""
        return " ".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))
