"""9. Quality classifier: a linear-chain conditional random field over lines.

Every line with words is labelled good or bad from its own features and those of the lines before and after it; the
forward-backward marginals of "good", weighted by line length, make the document's quality. A document's label stands
for all its lines in training. The field is fitted on at most SAMPLE labelled documents, those with the smallest hash of
their doc_id among the labelled ones outside the held-out fold; scoring covers every row. Features see the text alone.

Defined results: a null, empty or blank text scores 0; null doc_ids are scored and not held out; repeated rows are scored
each; without any labels to learn from, all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import documents, slices, table
from kgspark.llm.shingles import word_hashes

#: Labelled documents to fit on, at most.
SAMPLE = 4000
GOOD = 0.7
BINS = 6
STEPS, RATE, DECAY = 250, 0.05, 1e-4
_TABLE = np.zeros((8, 256), np.float32)
for _row, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>", b"0123456789", b".,;:!?", b"|", b"!", b"abcdefghijklmnopqrstuvwxyz")):
    _TABLE[_row, list(_chars)] = 1
_TABLE[7, 128:192] = 1  # continuation bytes, so that characters can be counted
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_END = np.zeros(256, bool)
_END[list(b".!?\"')")] = True
#: Upper ends of the bins of each feature but the last bin.
EDGES = np.array(
    [
        [0.005, 0.05, 0.15, 0.35, 0.6],  # capitals
        [0.001, 0.02, 0.05, 0.1, 0.2],  # symbols
        [0.001, 0.03, 0.1, 0.3, 0.6],  # digits
        [0.001, 0.01, 0.03, 0.06, 0.12],  # marks
        [0.001, 0.02, 0.05, 0.1, 0.2],  # bars
        [0.001, 0.01, 0.05, 0.1, 0.2],  # exclamation marks
        [0.2, 0.4, 0.6, 0.75, 0.9],  # small letters
        [2, 5, 10, 25, 60],  # words
        [2.5, 4, 5.5, 7, 10],  # bytes a word
        [0.01, 0.1, 0.3, 0.5, 0.75],  # words equal to the one before
        [0.05, 0.2, 0.4, 0.6, 0.9],  # words that end in a symbol
        [0.5, 1.5, 2.5, 3.5, 4.5],  # ends in a sentence mark
    ]
)
N = len(EDGES)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with words: bins (lines x N, uint8), text, length in word characters."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    h, _, _ = word_hashes(texts)
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    if not len(begin):
        return np.zeros((0, N), np.uint8), np.zeros(0, np.int64), np.zeros(0)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, begin)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    words = np.diff(np.r_[first, len(begin)]).astype(float)
    sums = np.stack([np.add.reduceat(t[data], begin[first]) for t in _TABLE])  # spaces and line ends count nothing
    nbytes = np.add.reduceat((~space).astype(np.float32), begin[first])
    chars = nbytes - sums[7]
    again = np.r_[False, h[1:] == h[:-1]]
    again[first] = False
    symbol_end = _TABLE[1][data[end - 1]]
    last = np.r_[first[1:], len(begin)] - 1
    x = np.stack(
        [
            *(sums[:7] / chars),
            words,
            nbytes / words,
            np.add.reduceat(again.astype(float), first) / words,
            np.add.reduceat(symbol_end, first) / words,
            _END[data[end[last] - 1]] * 1.0,
        ],
        1,
    )
    bins = (x[:, :, None] > EDGES[None]).sum(2).astype(np.uint8)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin[first], "right")
    return bins, doc, chars


def _columns(bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Indices of the active features of every line: its own, the former and the next line's, and a bias."""
    own = bins.astype(np.int64) + BINS * np.arange(N)
    size = N * BINS
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    alone = 3 * size  # no such line
    starts = np.r_[True, doc[1:] != doc[:-1]]
    ends = np.r_[starts[1:], True]
    before = np.where(starts[:, None], alone, before + size)
    after = np.where(ends[:, None], alone + 1, after + 2 * size)
    return np.concatenate([own, before, after, np.full((len(own), 1), alone + 2)], 1)


WIDTH = 3 * N * BINS + 3


def marginals(score: np.ndarray, move: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once. score: log-odds of good per line; move: 2 x 2 log weights.

    Returns the marginal of good per line and the expected counts of moves per line (to it from the one before).
    """
    n = len(score)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    lens = np.diff(np.r_[starts, n])
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    emit = np.stack([np.zeros(n), score], 1)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    alive = [int(np.searchsorted(-lens, -t, "left")) for t in range(int(lens[0]))]  # chains longer than t
    ahead[starts] = emit[starts]
    for t in range(1, len(alive)):
        at = starts[: alive[t]] + t
        prior = ahead[at - 1]
        for y in (0, 1):
            ahead[at, y] = np.logaddexp(prior[:, 0] + move[0, y], prior[:, 1] + move[1, y]) + emit[at, y]
    for t in range(len(alive) - 1, 0, -1):
        at = starts[: alive[t]] + t
        rest = back[at] + emit[at]
        for y in (0, 1):
            back[at - 1, y] = np.logaddexp(rest[:, 0] + move[y, 0], rest[:, 1] + move[y, 1])
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    pairs = np.zeros((n, 2, 2))
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    for a in (0, 1):
        for b in (0, 1):
            pairs[at, a, b] = np.exp(ahead[at - 1, a] + move[a, b] + emit[at, b] + back[at, b] - total[at])
    return good, pairs


def seen(cols: np.ndarray, doc: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each feature goes with a good line, and each label follows each other one inside a document."""
    inner = ~np.r_[True, doc[1:] != doc[:-1]]
    y = label.astype(int)
    moves = np.zeros((2, 2))
    np.add.at(moves, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    return np.bincount(cols.ravel(), np.repeat(label, cols.shape[1]), WIDTH), moves


def gradient(w: np.ndarray, move: np.ndarray, cols: np.ndarray, doc: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the conditional log-likelihood: counts seen less counts expected."""
    good, pairs = marginals(w[cols].sum(1), move, doc)
    return counts[0] - np.bincount(cols.ravel(), np.repeat(good, cols.shape[1]), WIDTH), counts[1] - pairs.sum(0)


def fit(bins: np.ndarray, doc: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves that maximize the regularized conditional likelihood (Adam, full gradient)."""
    cols = _columns(bins, doc)
    counts = seen(cols, doc, label)
    w, move = np.zeros(WIDTH), np.zeros((2, 2))
    m = v = np.zeros(WIDTH + 4)
    for step in range(1, STEPS + 1):
        by_w, by_move = gradient(w, move, cols, doc, counts)
        grad = np.r_[by_w, by_move.ravel()] / len(label)
        grad -= DECAY * np.r_[w, move.ravel()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        delta = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, move = w + delta[:-4], move + delta[-4:].reshape(2, 2)
    return w, move


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on the labelled documents (labels: doc_id, quality), at most ``sample`` of them; None without any."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most ``sample`` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bins, doc, _ = line_features([t.encode() for t in part.column("text").to_pylist()])
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                blobs = [bins[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("quality"), pa.array(blobs, pa.binary())], names=["id", "quality", "bins"])

    met = documents(docs).join(chosen, "doc_id").select(F.xxhash64("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"), "text")
    # One row for each chosen doc_id, also where it stands in several rows.
    once = met.mapInArrow(run, "id long, quality int, bins binary").groupBy("id", "quality").agg(F.min("bins").alias("bins"))
    rows = sorted((r for r in once.collect() if r.bins), key=lambda r: (r.id, bytes(r.bins)))
    if not rows:
        return None
    bins = [np.frombuffer(r.bins, np.uint8).reshape(-1, N) for r in rows]
    n = [len(b) for b in bins]
    return fit(np.concatenate(bins), np.repeat(np.arange(len(rows)), n), np.repeat([float(r.quality) for r in rows], n))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """doc_id, score, n_lines, n_bad_lines for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                bins, doc, chars = line_features([t.encode() for t in part.column("text").to_pylist()])
                if model is None:
                    good = np.full(len(doc), 0.5)
                else:
                    good = marginals(model[0][_columns(bins, doc)].sum(1), model[1], doc)[0] if len(doc) else np.zeros(0)
                weight = np.bincount(doc, chars, n)
                score = np.clip(np.bincount(doc, chars * good, n) / np.maximum(weight, 1), 0, 1)
                if model is None:
                    score[:] = 0.5
                lines, bad = np.bincount(doc, minlength=n), np.bincount(doc[good < 0.5], minlength=n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(lines), pa.array(bad)], names=["doc_id", "score", "n_lines", "n_bad_lines"])

    return documents(docs).mapInArrow(run, f"doc_id {kind}, score double, n_lines long, n_bad_lines long")


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"), "n_lines", "n_bad_lines"
    )
