"""Quality of media texts by a byte-level convolutional network, trained and run in numpy.

Filters over a few bytes slide over a text in overlapping chunks that cover all of it; each filter's largest
response per chunk, averaged over the chunks and at its maximum, is combined into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from spanweave.llm.common import column_of, filled_text, map_batches, scripts_of, texts_of

WIDTH, FILTERS = 5, 16
#: A chunk is two strides long and starts every stride.
STRIDE = 128
#: Bounds of the training sample: texts per class, and for each of them slices spread evenly over the text.
TRAIN_ROWS, TRAIN_SLICES, TRAIN_CHARS = 1000, 12, 512
EPOCHS, BATCH, RATE = 8, 32, 0.01
_BLOCK = 512  # strides at a time


@dataclass
class Network:
    """``table[w, byte, f]``: response of filter f to a byte at place w; then one logistic unit."""

    table: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float

    def strides(self, data: np.ndarray) -> np.ndarray:
        """Largest response of each filter that starts in each stride; ``data`` holds whole strides."""
        n = len(data) // STRIDE
        tail = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
        out = np.empty((n, FILTERS), np.float32)
        for at in range(0, n, _BLOCK):
            size = min(_BLOCK, n - at) * STRIDE
            first = at * STRIDE
            act = self.table[0][tail[first:first + size]]
            for w in range(1, WIDTH):
                act += self.table[w][tail[first + w:first + w + size]]
            out[at:at + _BLOCK] = act.reshape(-1, STRIDE, FILTERS).max(axis=1)
        return out + self.bias

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Mean and maximum over a text's chunks of each filter's largest response, at least 0."""
        data, sizes = padded(texts)
        most = np.maximum(self.strides(data), 0)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        # A chunk is a stride and the next one; the last stride of a text closes its last chunk.
        chunk = most.copy()
        inner = np.ones(len(most), bool)
        inner[ends - 1] = False
        where = np.flatnonzero(inner)
        chunk[where] = np.maximum(most[where], most[where + 1])
        mean = np.add.reduceat(chunk, starts, axis=0) / sizes[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunk, starts, axis=0)], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return _sigmoid(self.features(texts).astype(np.float64) @ self.weight + self.offset)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each filled with zero bytes to whole strides, and their numbers of strides.

    At least ``WIDTH - 1`` zeros stand before and behind each text, so that no filter sees two.
    """
    edge = WIDTH - 1
    sizes = np.array([-(-(len(t) + 2 * edge) // STRIDE) for t in texts], np.int64)
    laid = (bytes(edge) + t + bytes(n * STRIDE - edge - len(t)) for t, n in zip(texts, sizes.tolist()))
    return np.frombuffer(b"".join(laid), np.uint8), sizes


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss, both classes weighted alike. Only the places of maxima carry gradients back."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                  rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    if not len(texts):
        net.weight[:] = 0
        return net
    share = np.bincount(labels, minlength=2) / len(labels)
    worth = 0.5 / np.maximum(share, 1e-9)
    if (share == 0).any():
        net.weight[:], net.offset = 0, (3.0 if share[1] else -3.0)
        return net
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (net.table, net.bias, net.weight, np.zeros(1))]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(rng.permutation(len(texts)), -(-len(texts) // BATCH)):
            step += 1
            grads = _gradients(net, [texts[i] for i in at], labels[at], worth)
            offset = np.array([net.offset])
            for p, g, (m, v) in zip((net.table, net.bias, net.weight, offset), grads, state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(p.dtype)
            net.offset = float(offset[0])
    return net


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray, worth: np.ndarray):
    data, sizes = padded(texts)
    tail = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
    act = net.table[0][data]
    for w in range(1, WIDTH):
        act += net.table[w][tail[w:w + len(data)]]
    act = act.reshape(-1, STRIDE, FILTERS)
    place = act.argmax(axis=1) + np.arange(len(act))[:, None] * STRIDE
    most = act.max(axis=1) + net.bias
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    # The stride that stands for each chunk and filter.
    later = np.minimum(np.arange(len(most)) + 1, ends[owner] - 1)
    stands = np.where(most[later] > most, later[:, None], np.arange(len(most))[:, None])
    chunk = np.take_along_axis(most, stands, axis=0)
    positive = np.maximum(chunk, 0)
    mean = np.add.reduceat(positive, ends - sizes, axis=0) / sizes[:, None]
    peak = np.maximum.reduceat(positive, ends - sizes, axis=0)
    features = np.concatenate([mean, peak], axis=1).astype(np.float64)
    p = _sigmoid(features @ net.weight + net.offset)
    error = (p - labels) * worth[labels] / len(labels)
    back = error[:, None] * net.weight[None, :]
    on = chunk > 0
    grad = back[owner, :FILTERS] / sizes[owner][:, None] * on
    # The first chunk that reaches the text's maximum takes its gradient.
    top = (chunk == peak[owner]) & on
    rank = np.cumsum(top, axis=0)
    before = rank[ends - sizes] - top[ends - sizes]
    grad += back[owner, FILTERS:] * (top & (rank - before[owner] == 1))
    at = np.take_along_axis(place, stands, axis=0)
    table = np.empty_like(net.table)
    filters = np.broadcast_to(np.arange(FILTERS), at.shape)
    for w in range(WIDTH):
        flat = tail[at + w].astype(np.int64) * FILTERS + filters
        table[w] = np.bincount(flat.ravel(), grad.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return table, grad.sum(axis=0).astype(np.float32), features.T @ error + 1e-4 * net.weight, np.array([error.sum()])


def training_sample(scripts: DataFrame, labels: DataFrame) -> DataFrame:
    """``text_slices`` and ``label`` of at most ``TRAIN_ROWS`` labelled media per class, in an order set by hash.

    ``labels``: ``media_id``, ``label`` (0 or 1; other values and nulls are left out). The media are chosen among
    the labels, so of the texts only those are shuffled.
    """
    known = labels.where(F.col("label").isin(0, 1)).select("media_id", F.col("label").cast("int").alias("label"))
    # An id that is labelled more than once counts once, with its smallest label.
    known = known.groupBy("media_id").agg(F.min("label").alias("label"))
    by_hash = [F.xxhash64(F.col("media_id")), F.col("media_id")]
    chosen = known.where("label = 0").orderBy(*by_hash).limit(TRAIN_ROWS).union(known.where("label = 1").orderBy(*by_hash).limit(TRAIN_ROWS))
    # One text of each id, the one with the smallest hash, so that the bound on ids is one on texts.
    digest = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    own = filled_text(scripts_of(scripts)).join(F.broadcast(chosen), "media_id")  # 2 * TRAIN_ROWS ids at most
    least = F.min(F.struct(digest.alias("d"), "label", _slices(F.col("text")).alias("text_slices")))
    return own.groupBy("media_id").agg(least.alias("r")).select("media_id", "r.text_slices", "r.label")


def _slices(text: Column) -> Column:
    """A short text whole; of a longer one slices over all of its length."""
    step = F.greatest(F.char_length(text) - TRAIN_CHARS, F.lit(0)) / (TRAIN_SLICES - 1)
    slices = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_SLICES - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(TRAIN_CHARS)))
    return F.when(F.char_length(text) <= TRAIN_CHARS * TRAIN_SLICES, F.array(text)).otherwise(slices)


def fit_quality(scripts: DataFrame, labels: DataFrame) -> Network:
    """Train on a bounded sample of labelled media, see ``training_sample``; the driver holds that sample alone."""
    rows = sorted(training_sample(scripts, labels).collect(), key=lambda r: (str(r.media_id), r.text_slices))
    texts = ["".join(r.text_slices).encode("utf-8", "surrogatepass") for r in rows]
    return train(texts, np.array([r.label for r in rows], np.int64))


def score_quality(scripts: DataFrame, network: Network, *carried: str) -> DataFrame:
    """``media_id``, ``score``: the probability that a text is of good quality, from its whole text alone.

    ``scripts``: ``media_id``, ``text``; other columns are left out, but for those named in ``carried``. One row per input row. Null and empty texts get
    the score of an empty text. No shuffle; the network is some kilobytes.
    """
    sent = scripts.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts_of(batch)]
            scores, part, size = [np.zeros(0)], [], 0
            for t in raw:
                part.append(t)
                size += len(t)
                if size > 4 << 20:
                    scores.append(sent.value.score(part))
                    part, size = [], 0
            scores.append(sent.value.score(part))
            yield pa.RecordBatch.from_arrays([*[column_of(batch, c) for c in kept], pa.array(np.concatenate(scores))], names=[*kept, "score"])

    kept = ("media_id", *carried)
    more = [c for c in carried if c != "text"]
    return map_batches(scripts_of(scripts, *more), run, StructField("score", DoubleType()), keep=kept)
