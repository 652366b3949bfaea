"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded, ``FILTERS`` learned filters of ``WIDTH`` bytes look at overlapping chunks, one every
``STRIDE`` bytes from the first byte to past the last, so every byte is seen; each filter's response is max-pooled over
the text, and (so that one odd chunk in a long text does not decide alone) averaged over it; one layer combines the
pooled values into a probability.  Trained with Adam on the driver from at most ``TRAIN_TEXTS`` labelled texts (those
with the smallest hash), of which every epoch sees up to ``TRAIN_BYTES`` bytes from a seeded place of the whole text (the
executors cut them, so no long text travels), while scoring covers every byte of every text.

Labels come only from rows whose crc32(doc_id as text) mod 4 is not 2.  Only text is an input of a score.

Defined results: a null or empty text is scored as one chunk of padding; a doc_id of null is never labelled and is held
out if crc32('') mod 4 is 2 (it is not); several labels of one doc_id are all used; without labels of both kinds the
score is the share of label 1 (0.5 without any) for every text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, flat, table

EMBED = 8
WIDTH = 16
STRIDE = 4
FILTERS = 16
TRAIN_TEXTS = 2400
TRAIN_BYTES = 2048
EPOCHS = 12
BATCH = 32
RATE = 0.01
DECAY = 1e-4
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
SEED = 7
#: Texts whose padded bytes are convolved together when scoring.
SCORE_BYTES = 1 << 18

_TAPS = WIDTH // STRIDE
#: Id of the padding behind a text; bytes are 0 to 255.
_PAD = 256


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind one another, each padded to whole strides plus the rest of a chunk; and their chunk offsets."""
    lengths = np.diff(offsets)
    chunks = np.maximum(1, -(-lengths // STRIDE))
    blocks = chunks + _TAPS - 1
    starts = np.append(0, np.cumsum(blocks))
    out = np.full(starts[-1] * STRIDE, _PAD, np.int16)
    place = np.repeat(starts[:-1] * STRIDE - offsets[:-1], lengths) + np.arange(offsets[-1])
    out[place] = data
    return out, starts


class ByteCNN:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = {
            "embed": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
            "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (STRIDE * EMBED, _TAPS * FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32),
            "shift": np.zeros(1, np.float32),
        }
        self.w["embed"][_PAD] = 0
        self.share: float | None = None

    def forward(self, ids: np.ndarray, starts: np.ndarray, keep: bool = False):
        w = self.w
        x = w["embed"][ids].reshape(-1, STRIDE * EMBED)
        taps = x @ w["filters"]
        n = len(x)
        # row b: the chunk that starts with block b; the last _TAPS - 1 blocks of a text start none
        y = taps[:, :FILTERS].copy()
        for t in range(1, _TAPS):
            y[: n - t] += taps[t:, t * FILTERS : (t + 1) * FILTERS]
        y += w["bias"]
        np.maximum(y, 0, out=y)
        sizes = np.diff(starts) - (_TAPS - 1)
        edges = np.column_stack([starts[:-1], starts[:-1] + sizes]).ravel()
        edges = edges[:-1] if edges[-1] >= n else edges
        top = np.maximum.reduceat(y, edges, axis=0)[::2]
        mean = np.add.reduceat(y, edges, axis=0)[::2] / sizes[:, None]
        pooled = np.concatenate([top, mean], axis=1)
        p = 1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["shift"], -30, 30)))
        return (p, pooled, y, x, edges, sizes) if keep else p

    def gradient(self, ids: np.ndarray, starts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        p, pooled, y, x, edges, sizes = self.forward(ids, starts, keep=True)
        err = ((p - label) / len(label)).astype(np.float32)
        back = err[:, None] * w["out"]
        dy = np.zeros_like(y)
        text = np.repeat(np.arange(len(sizes)), sizes)
        rows = np.repeat(starts[:-1] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        dy[rows] = (back[:, FILTERS:] / sizes[:, None])[text]
        for f in range(FILTERS):  # the first chunk that holds the maximum takes its share
            hit = np.flatnonzero(y[rows, f] == pooled[text, f])
            first = hit[np.unique(text[hit], return_index=True)[1]]
            dy[rows[first], f] += back[text[first], f]
        dy[y <= 0] = 0
        d_taps = np.zeros((len(y), _TAPS * FILTERS), np.float32)
        for t in range(_TAPS):
            d_taps[t:, t * FILTERS : (t + 1) * FILTERS] = dy[: len(y) - t]
        dx = (d_taps @ w["filters"].T).reshape(-1, EMBED)
        d_embed = np.stack([np.bincount(ids, dx[:, e], 257) for e in range(EMBED)], 1).astype(np.float32)
        d_embed[_PAD] = 0
        return {"embed": d_embed, "filters": x.T @ d_taps, "bias": dy.sum(0), "out": pooled.T @ err, "shift": err.sum(keepdims=True)}

    def fit(self, texts: list[bytes | list[bytes]], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> "ByteCNN":
        """A text is given whole, or as the crops of it that the epochs see in turn."""
        label = np.array(labels, np.float32)
        if len(set(labels)) < 2:
            self.share = float(label.mean()) if len(label) else 0.5
            return self
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                some = order[lo : lo + BATCH]
                parts = []
                for i in some:
                    if isinstance(texts[i], list):
                        parts.append(texts[i][epoch % len(texts[i])])
                        continue
                    room = max(0, len(texts[i]) - TRAIN_BYTES)
                    at = int(rng.integers(0, room + 1))
                    parts.append(texts[i][at : at + TRAIN_BYTES])
                offsets = np.append(0, np.cumsum([len(x) for x in parts]))
                ids, starts = padded(np.frombuffer(b"".join(parts), np.uint8), offsets)
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for k, g in self.gradient(ids, starts, label[some]).items():
                    g = g + DECAY * self.w[k]
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.share is not None:
            return np.full(n, self.share)
        out, lo = np.zeros(n), 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SCORE_BYTES, side="right")) - 1)
            hi = min(n, hi)
            if offsets[hi] - offsets[lo] > 4 * SCORE_BYTES:
                out[lo] = self._long(data[offsets[lo] : offsets[hi]])
            else:
                ids, starts = padded(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                out[lo:hi] = self.forward(ids, starts)
            lo = hi
        return out

    def _long(self, data: np.ndarray) -> float:
        """One very long text in pieces that share no chunk: maxima and sums are combined."""
        top, total, count = None, 0.0, 0
        for lo in range(0, len(data), SCORE_BYTES):
            part = data[lo : lo + SCORE_BYTES]
            more = data[lo + SCORE_BYTES : lo + SCORE_BYTES + WIDTH - STRIDE]
            # the bytes behind the piece stand where its padding would
            ids, starts = padded(part, np.array([0, len(part)]))
            tail = -(-len(part) // STRIDE) * STRIDE
            ids[tail : tail + len(more)] = more
            _, pooled, _, _, _, sizes = self.forward(ids, starts, keep=True)
            top = pooled[0, :FILTERS] if top is None else np.maximum(top, pooled[0, :FILTERS])
            total = total + pooled[0, FILTERS:].astype(np.float64) * sizes[0]
            count += sizes[0]
        z = np.concatenate([top, total / count]) @ self.w["out"] + self.w["shift"][0]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def crops(text: bytes, n: int = EPOCHS, size: int = TRAIN_BYTES) -> list[bytes]:
    """``n`` stretches of ``size`` bytes, one from a place in each n-th of the text, seeded by the text (a short text itself)."""
    room = len(text) - size
    if room <= 0:
        return [text]
    rng = np.random.default_rng([SEED, zlib.crc32(text)])
    at = ((np.arange(n) + rng.random(n)) * (room + 1) / n).astype(np.int64)
    return [text[x : x + size] for x in rng.permutation(at).tolist()]


def _crop(batches):
    for batch in batches:
        cut = [crops(t or b"") for t in as_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.list_(pa.binary()))], ["doc_id", "quality", "crops"])


def train(documents: DataFrame, labels: DataFrame, most: int = TRAIN_TEXTS) -> ByteCNN:
    """Fit on at most ``most`` labelled texts outside the held-out fold, by crops from all over each text."""
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & usable).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # ids may repeat: again the first of all rows, so that what comes to the driver stays bounded
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("text")).limit(most).select(F.col("doc_id").cast("string"), "quality", "text")
    rows = texts.mapInArrow(_crop, "doc_id string, quality int, crops array<binary>").collect()  # EPOCHS * TRAIN_BYTES a text at most
    rows = sorted(((r["doc_id"], r["quality"], [bytes(c) for c in r["crops"]]) for r in rows))
    return ByteCNN().fit([c for _, _, c in rows], [q for _, q, _ in rows])


def score(documents: DataFrame, model: ByteCNN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and score of every row, from its whole text."""

    def work(batches):
        for batch in batches:
            data, offsets = flat(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(model.scores(data, offsets), pa.float64())], [*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    return documents.select(*keep, F.col("text").alias("__text")).mapInArrow(work, f"{fields}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = score(documents, train(documents, table(spark, sf_dir, "labels")))
    fold_of = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return found.select("doc_id", (fold_of == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
