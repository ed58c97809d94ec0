"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte
has a learned embedding; learned filters slide over a chunk and their responses are
max-pooled. A document combines its chunks' pooled responses, as their mean and their
maximum, into one probability by a logistic unit. Everything is trained here, by Adam on
the log loss, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, STEP = 1024, 896
WIDTH, STRIDE, DIMS, FILTERS = 12, 4, 8, 24
#: At most so many labelled rows are used for training: those with the smallest hash of their id.
TRAIN_ROWS = 3000
#: Rows with more bytes of text aren't trained on (all are scored whole), so the sample's bytes are bounded, too.
TRAIN_BYTES = 131_072
EPOCHS, BATCH_CHUNKS, RATE = 8, 160, 0.01
#: A small sample is gone over more often, until so many steps are made.
LEAST_STEPS = 400
#: Chunks scored at a time, for bounded memory.
SCORE_CHUNKS = 256
_PLACES = (CHUNK - WIDTH) // STRIDE + 1


@dataclass
class Net:
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    mean_weight: np.ndarray
    max_weight: np.ndarray
    offset: np.ndarray

    @classmethod
    def start(cls, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(draw(0.5, 256, DIMS), draw((WIDTH * DIMS) ** -0.5, WIDTH * DIMS, FILTERS), np.zeros(FILTERS, np.float32), draw(0.1, FILTERS), draw(0.1, FILTERS), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.mean_weight, self.max_weight, self.offset]


def cut(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(chunks x CHUNK bytes, bytes in each). The last chunk ends where the text does; an empty text is one empty chunk."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if len(raw) <= CHUNK:
        out = np.zeros((1, CHUNK), np.uint8)
        out[0, : len(raw)] = raw
        return out, np.array([len(raw)])
    starts = np.unique(np.r_[np.arange(0, len(raw) - CHUNK, STEP), len(raw) - CHUNK])
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[starts], np.full(len(starts), CHUNK)


def _windows(net: Net, chunks: np.ndarray) -> np.ndarray:
    """chunks x places x (WIDTH * DIMS), without copying overlapping bytes before the product."""
    embedded = net.embedding[chunks]
    a, b, c = embedded.strides
    return np.lib.stride_tricks.as_strided(embedded, (len(chunks), _PLACES, WIDTH * DIMS), (a, b * STRIDE, c))


def _pool(net: Net, chunks: np.ndarray, lengths: np.ndarray, places: bool = False):
    response = (_windows(net, chunks).reshape(-1, WIDTH * DIMS) @ net.filters).reshape(len(chunks), _PLACES, FILTERS)
    short = np.flatnonzero(lengths < CHUNK)
    for k in short:  # places past the end don't count; the first always does
        response[k, max(1, -(-int(lengths[k]) // STRIDE)) :] = -np.inf
    if places:
        at = response.argmax(1)
        return np.take_along_axis(response, at[:, None], 1)[:, 0] + net.bias, at
    return response.max(1) + net.bias


def _combine(net: Net, pooled: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability, mean, maximum) of documents whose chunks start at ``starts``."""
    active = np.maximum(pooled, 0)
    sizes = np.diff(np.r_[starts, len(pooled)])
    mean = np.add.reduceat(active, starts) / sizes[:, None]
    most = np.maximum.reduceat(active, starts)
    z = mean @ net.mean_weight + most @ net.max_weight + net.offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), mean, most


def _gradients(net: Net, chunks: np.ndarray, lengths: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    pooled, at = _pool(net, chunks, lengths, places=True)
    p, mean, most = _combine(net, pooled, starts)
    dz = ((p - labels) / len(labels)).astype(np.float32)
    sizes = np.diff(np.r_[starts, len(pooled)])
    doc = np.repeat(np.arange(len(starts)), sizes)
    d = dz[doc, None] * net.mean_weight / sizes[doc, None] + dz[doc, None] * net.max_weight * (pooled == most[doc])
    d = (d * (pooled > 0)).astype(np.float32)
    # Only the place that won the pooling gets a gradient.
    k, f = np.nonzero(d)
    seen = chunks[k[:, None], at[k, f][:, None] * STRIDE + np.arange(WIDTH)]
    window, g = net.embedding[seen].reshape(len(k), -1), d[k, f]
    d_filters = np.zeros_like(net.filters)
    for j in range(FILTERS):
        mine = f == j
        d_filters[:, j] = g[mine] @ window[mine]
    d_embedding = np.zeros_like(net.embedding)
    np.add.at(d_embedding, seen.reshape(-1), (net.filters.T[f] * g[:, None]).reshape(-1, DIMS))
    return [d_embedding, d_filters, d.sum(0), dz @ mean, dz @ most, dz.sum(keepdims=True)]


def train(texts: list[str], labels: list[int], seed: int = 7) -> Net:
    """A network trained on whole texts; rows are taken in a seeded order."""
    net, rng = Net.start(seed), np.random.default_rng(seed)
    cuts, y = [cut(t) for t in texts], np.array(labels, np.float32)
    weight = [p for p in net.parameters()]
    first, second, step = [np.zeros_like(p) for p in weight], [np.zeros_like(p) for p in weight], 0
    batches_per_epoch = max(1, sum(len(c) for c, _ in cuts) // BATCH_CHUNKS)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches_per_epoch))
    for _ in range(epochs):
        batch: list[int] = []
        size = 0
        order = rng.permutation(len(texts))
        for n, i in enumerate(order):
            batch.append(i)
            size += len(cuts[i][0])
            if size < BATCH_CHUNKS and n + 1 < len(order):
                continue
            starts = np.r_[0, np.cumsum([len(cuts[k][0]) for k in batch])[:-1]].astype(np.int64)
            grads = _gradients(net, np.concatenate([cuts[k][0] for k in batch]), np.concatenate([cuts[k][1] for k in batch]), starts, y[batch])
            step += 1
            rate = RATE * max(0.05, 1 - step / (epochs * batches_per_epoch + 1))
            for p, g, a, b in zip(weight, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            batch, size = [], 0
    return net


def score_texts(net: Net, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each whole text."""
    out = np.zeros(len(texts))
    chunks: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    sizes: list[int] = []
    done = held = 0

    def flush() -> None:
        nonlocal done, held
        c, n = np.concatenate(chunks), np.concatenate(lengths)
        pooled = np.concatenate([_pool(net, c[a : a + SCORE_CHUNKS], n[a : a + SCORE_CHUNKS]) for a in range(0, len(c), SCORE_CHUNKS)])
        starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        out[done : done + len(sizes)] = _combine(net, pooled, starts)[0]
        done += len(sizes)
        held = 0
        chunks.clear()
        lengths.clear()
        sizes.clear()

    for t in texts:
        c, n = cut(t)
        chunks.append(c)
        lengths.append(n)
        sizes.append(len(c))
        held += len(c)
        if held >= SCORE_CHUNKS:
            flush()
    if sizes:
        flush()
    return out


def held_out(id_col: str = "doc_id"):
    """Rows that training must not see: crc32 of the id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on_labels(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = 7) -> Net | None:
    """A network from at most ``rows`` labelled documents of at most TRAIN_BYTES that aren't held out; None without any.

    The rows are those with the smallest hash of their id, so the sample doesn't depend on
    partitions. Labels other than 0 and 1 and rows without an id are ignored.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality").dropDuplicates(["doc_id"])
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").limit(2 * rows).collect()
    return train([r["text"] or "" for r in sample], [r["quality"] for r in sample], seed) if sample else None


def classify(docs: DataFrame, net: Net | None, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) plus ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Only the text is an input. Null counts as empty, which is scored like any text. Without
    a network (no labelled rows) the score is 0.5. Texts of any length are scored whole, in
    chunks. Repeated rows each get a row, an empty table gives none; input columns named
    like a result column are replaced.
    """
    keep = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column("text").to_pylist()
                score = np.full(len(texts), 0.5) if net is None else score_texts(net, texts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
