"""Quality classifier: supervised subword embeddings.

Hashed word, word-pair and character n-gram features each have a learned vector; a document is their average,
and a softmax over two outputs gives the probability of label 1.  Trained by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._hashing import FOLD, _block_words, mix
from ._shared import shuffle_key, small_batches

BUCKETS_LOG2 = 17
BUCKETS = 1 << BUCKETS_LOG2
SAME, END = BUCKETS, BUCKETS + 1  # a word pair of one word twice; the end of a text
SEGMENT = 1 << 19
#: At most so many labelled documents are learned from, the first in a seeded random order.
MAX_TRAIN_DOCS = 6000


class QualityModel(NamedTuple):
    vectors: np.ndarray  # (BUCKETS + 2, dim)
    output: np.ndarray  # (dim, 2)
    bias: np.ndarray  # (2,)

    def margins(self) -> np.ndarray:
        """Each feature's own part in the difference of the two outputs: a document's is the average of them."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)


def _bucket64(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def feature_blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, buckets) of the features of texts that lie one after another with a blank between.

    A place is the byte where the feature starts.  Features that start in one text and end in another are not made.
    """
    data = FOLD[np.frombuffer(b" ".join(texts), np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, h = _block_words(data)
    yield start, _bucket64(mix(h ^ np.uint64(11)))
    if len(start) > 1:
        own = np.searchsorted(ends, start, "right")
        pair = own[1:] == own[:-1]
        twice = h[1:] == h[:-1]
        both = _bucket64(mix(h[:-1] * np.uint64(3) + h[1:]))
        yield start[:-1][pair], np.where(twice, SAME, both)[pair]
    wide = data.astype(np.uint32)
    gram = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16) if len(data) > 2 else wide[:0]
    for n, salt in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        if n == 4:
            gram = gram[:-1] | wide[3:] << np.uint32(24) if len(data) > 3 else gram[:0]
        cross = np.zeros(len(data), bool)
        for k in range(n):  # a text's last n - 1 bytes and the blank behind it
            at = ends - 1 - k
            cross[at[(at >= 0) & (at < len(data))]] = True
        good = np.flatnonzero(~cross[: len(gram)])
        yield good, ((gram[good] * np.uint32(salt)) >> np.uint32(32 - BUCKETS_LOG2)).astype(np.int64)


def _segments(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + SEGMENT] for i in range(0, len(raw), SEGMENT)] or [b""]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and how often each occurs, in 32 bits each: all texts that are learned from are held at once."""
    count = np.zeros(BUCKETS + 2, np.int64)
    for part in _segments(text):
        for _, bucket in feature_blocks([part]):
            count += np.bincount(bucket, minlength=BUCKETS + 2)
    count[END] = 1
    at = np.flatnonzero(count)
    return at.astype(np.int32), count[at].astype(np.int32)


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 3) -> QualityModel:
    rnd = np.random.default_rng(seed)
    model = QualityModel(rnd.uniform(-1 / dim, 1 / dim, (BUCKETS + 2, dim)).astype(np.float32), np.zeros((dim, 2), np.float32), np.zeros(2, np.float32))
    model.output[:] = rnd.uniform(-0.1, 0.1, (dim, 2))
    steps, done = max(1, epochs * len(labels)), 0
    for _ in range(epochs):
        for i in rnd.permutation(len(labels)):
            at, count = features[i]
            share = (count / count.sum()).astype(np.float32)
            mean = share @ model.vectors[at]
            z = mean @ model.output + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = model.output @ p
            model.output[:] -= step * np.outer(mean, p)
            model.bias[:] -= step * 0.1 * p
            # shares are far below 1, so vectors move by their root: rare features learn as well
            model.vectors[at] -= (step * np.sqrt(share))[:, None] * back
            done += 1
    return model


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_TRAIN_DOCS) -> QualityModel | None:
    """A model of ``label_col`` (0 or 1) learned from the whole texts of at most ``max_docs`` labelled rows.

    The sample is a seeded random one; it is learned from in one task, whose size the bound limits.  Rows with null id or label are
    passed over; an id with both labels counts as 0; ids that repeat in ``docs`` are all learned from.  None
    without any labelled row.  Only the texts are inputs.
    """
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    picked = marked.orderBy(shuffle_key(5, F.col("_id")), "_id").limit(max_docs)  # max_docs rows: may be broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id").repartition(1)
    small_batches(docs.sparkSession)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            for i, text, label in zip(batch["_id"], batch["_text"], batch["_label"], strict=True):
                seen.append((i.as_py(), document_features(text.as_py()), label.as_py()))
        if not seen:
            return
        seen.sort(key=lambda x: (str(x[0]), len(x[1][0]), int(x[1][1].sum())))  # whatever order the rows came in
        model = fit([x[1] for x in seen], [x[2] for x in seen])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in model], list(model._fields))

    found = rows.mapInArrow(learn, "vectors binary, output binary, bias binary").collect()
    if not found:
        return None
    vectors, output, bias = (np.frombuffer(bytes(x), np.float32) for x in found[0])
    return QualityModel(vectors.reshape(BUCKETS + 2, -1), output.reshape(-1, 2), bias)


def score_texts(margin: np.ndarray, bias: float, texts: list[str | None]) -> np.ndarray:
    total = np.full(len(texts), margin[END], np.float64)
    count = np.ones(len(texts))
    parts = [(i, x) for i, t in enumerate(texts) for x in _segments(t)]
    at = 0
    while at < len(parts):
        to, size = at + 1, len(parts[at][1])
        while to < len(parts) and size + 1 + len(parts[to][1]) <= SEGMENT:
            size += 1 + len(parts[to][1])
            to += 1
        own = np.array([i for i, _ in parts[at:to]])
        ends = np.cumsum([len(x) + 1 for _, x in parts[at:to]])
        for place, bucket in feature_blocks([x for _, x in parts[at:to]]):
            cut = np.concatenate([[0], np.searchsorted(place, ends)])
            run = np.concatenate([[0.0], np.cumsum(margin[bucket], dtype=np.float64)])
            np.add.at(total, own, run[cut[1:]] - run[cut[:-1]])
            np.add.at(count, own, np.diff(cut))
        at = to
    return 1 / (1 + np.exp(-(total / count + bias)))


def quality_score(text: Column | str, model: QualityModel | None, docs: DataFrame) -> Column:
    """Probability (double) that the whole text has label 1; 0.5 for every text where no label was learned from (None).

    Null and empty texts have the feature of a text's end only.  A text over SEGMENT bytes is read in segments that n-grams do not
    span.  ``docs`` is the frame the column is for.
    """
    if model is None:
        return F.lit(0.5)
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.margins(), float(model.bias[1] - model.bias[0])))  # 0.5 MB

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        margin, bias = held.value
        for texts in batches:
            yield pa.array(score_texts(margin, bias, texts.to_pylist()), pa.float64())

    return F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)(text)
