"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes run over every byte of a document. Their rectified responses are averaged over chunks of
2 * BLOCK bytes that overlap by half and cover the whole text. A chunk also carries how often its bytes equal the byte
a few places before (the best and the mean share over LAGS lags), which a linear filter can't see and which shows
stuttering text. A dense layer turns each chunk into HIDDEN units, which are max-pooled over the chunks of the document
and combined into one probability.

Training is plain backpropagation with Adam on a bounded sample: at most TRAIN_ROWS labelled documents outside the
held-out fifth, each of at most TRAIN_BYTES bytes. Only text enters a score. Scoring streams: memory is bounded by one
piece of 1,024 blocks plus a few numbers a block.

Defined cases: a null text scores as an empty one; an empty text has one empty chunk; with no labelled rows the network
is untrained and scores the prior 0.5; repeated rows score alike; a null id counts as held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panweave.llm import _conv, _text
from panweave.llm._spark import read, tidy

BLOCK, WIDTH, DEPTH, FILTERS, HIDDEN = 64, 6, 8, 16, 16
LAGS = tuple(range(2, 26))
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, BATCH, RATE, SEED = 3000, 16_384, 9, 16, 5e-3, 7
MIN_STEPS = 900  # a small sample is passed over more often
THRESHOLD = 0.3
PIECE = 1024  # blocks


class Net:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (256, DEPTH)), "filters": r.normal(0, 0.35, (WIDTH, DEPTH, FILTERS)), "bias": np.zeros(FILTERS),
            "mixer": r.normal(0, 0.4, (FILTERS + 2, HIDDEN)), "mixer_bias": np.zeros(HIDDEN), "out": r.normal(0, 0.2, HIDDEN), "prior": np.zeros(1),
        }

    def blocks(self, lay: _conv.Layout, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Sums over each block: filter responses (and the responses themselves for training), lag matches."""
        looked = _conv.tables(self.p["emb"], self.p["filters"])
        bias = self.p["bias"].astype(np.float32)
        sums, z_all = np.empty((len(lay), FILTERS), np.float32), []
        for at in range(0, len(lay), PIECE):
            end = min(len(lay), at + PIECE)
            z = _conv.convolve(lay.bytes[at * BLOCK : end * BLOCK + _conv.HALO], (end - at) * BLOCK, looked, bias).reshape(end - at, BLOCK, FILTERS)
            for b in np.flatnonzero(lay.valid[at:end] < BLOCK).tolist():
                z[b, lay.valid[at + b] :] = 0
            sums[at:end] = z.sum(axis=1)
            if keep:
                z_all.append(z)
        return sums, np.concatenate(z_all) if keep else sums

    @staticmethod
    def lags(lay: _conv.Layout) -> np.ndarray:
        """(blocks, lags): bytes of the block that equal the byte `lag` places before, in the same document."""
        n = len(lay) * BLOCK
        out = np.zeros((len(lay), len(LAGS)), np.float32)
        data = lay.bytes[:n]
        alive = data != 0
        head = lay.first[:-1, None] * BLOCK
        for i, lag in enumerate(LAGS):
            same = np.zeros(n, np.uint8)
            np.logical_and(data[lag:] == data[:-lag], alive[lag:], out=same[lag:].view(bool))
            same[(head + np.arange(lag)).ravel()] = 0  # there the place before lies in another document
            out[:, i] = same.reshape(-1, BLOCK).sum(axis=1)
        return out

    def chunk_features(self, lay: _conv.Layout, sums: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features of the overlapping chunks, their first blocks, lengths and the chunk offsets of the documents."""
        chunks = np.maximum(1, lay.blocks - 1)
        first_chunk = np.concatenate(([0], np.cumsum(chunks)))
        start = np.repeat(lay.first[:-1] - first_chunk[:-1], chunks) + np.arange(first_chunk[-1])
        second = np.minimum(start + 1, np.repeat(lay.first[:-1] + lay.blocks - 1, chunks))
        pair = (second > start)[:, None]
        size = (lay.valid[start] + np.where(second > start, lay.valid[second], 0)).astype(np.float64)
        scale = 1 / np.maximum(size, 1)[:, None]
        conv = (sums[start] + np.where(pair, sums[second], 0)) * scale
        match = (lags[start] + np.where(pair, lags[second], 0)) * scale
        return np.column_stack((conv, 2 * match.max(axis=1), 4 * match.mean(axis=1))), start, size, first_chunk

    def score(self, chunk: _text.Chunk) -> np.ndarray:
        lay = _conv.Layout(chunk, BLOCK)
        sums, _ = self.blocks(lay)
        x, _, _, first = self.chunk_features(lay, sums, self.lags(lay))
        hidden = np.tanh(x @ self.p["mixer"] + self.p["mixer_bias"])
        pooled = np.maximum.reduceat(hidden, first[:-1], axis=0)
        return 1 / (1 + np.exp(-(pooled @ self.p["out"] + self.p["prior"])))

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Net:
        if not texts:
            return self
        y_all = np.array(labels, np.float64)
        self.p["prior"][:] = np.log((y_all.mean() + 1e-3) / (1 - y_all.mean() + 1e-3))
        r = np.random.default_rng(SEED)
        batches = []
        order = np.argsort([len(t) for t in texts], kind="stable")  # alike lengths together, so that batches are alike in bytes
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            chunk = next(_text.chunks(pa.array([texts[i] for i in own], pa.large_string()), 1 << 40))
            lay = _conv.Layout(chunk, BLOCK)
            batches.append((lay, self.lags(lay), y_all[own]))
        opt, epochs = _conv.Adam(self.p, RATE), max(epochs, -(-MIN_STEPS // len(batches)))
        for epoch in range(epochs):
            opt.rate = RATE * (1 - epoch / epochs) ** 0.5
            for b in r.permutation(len(batches)):
                opt.step(self._grads(*batches[b]))
        return self

    def _grads(self, lay: _conv.Layout, lags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        sums, z = self.blocks(lay, keep=True)
        x, start, size, first = self.chunk_features(lay, sums, lags)
        hidden = np.tanh(x @ p["mixer"] + p["mixer_bias"])
        doc = np.repeat(np.arange(len(y)), np.diff(first))
        pooled = np.maximum.reduceat(hidden, first[:-1], axis=0)
        # the chunk that gives each unit its maximum: the first of a document on ties
        top = np.empty(pooled.shape, np.int64)
        for u in range(HIDDEN):
            at = np.flatnonzero(hidden[:, u] == pooled[doc, u])
            top[doc[at][::-1], u] = at[::-1]
        prob = 1 / (1 + np.exp(-(pooled @ p["out"] + p["prior"])))
        err = (prob - y) / len(y)
        g = {"out": pooled.T @ err + 1e-4 * p["out"], "prior": np.array([err.sum()])}
        d_pool = err[:, None] * p["out"][None] * (1 - pooled**2)
        used, back = np.unique(top, return_inverse=True)
        d_hidden = np.zeros((len(used), HIDDEN))
        d_hidden[back.reshape(top.shape), np.arange(HIDDEN)[None]] = d_pool
        g["mixer"] = x[used].T @ d_hidden + 1e-4 * p["mixer"]
        g["mixer_bias"] = d_hidden.sum(axis=0)
        d_x = (d_hidden @ p["mixer"].T)[:, :FILTERS] / np.maximum(size[used], 1)[:, None]
        own = np.searchsorted(lay.first, start[used], side="right") - 1
        last = np.minimum(start[used] + 1, lay.first[own] + lay.blocks[own] - 1)
        block = np.concatenate((start[used], last[last > start[used]]))
        d_block = np.concatenate((d_x, d_x[last > start[used]]))
        d_z = (d_block[:, None, :] * (z[block] > 0)).reshape(-1, FILTERS)
        place = (block[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        g["bias"] = d_z.sum(axis=0)
        g["filters"], g["emb"] = np.zeros_like(p["filters"]), np.zeros_like(p["emb"])
        for j in range(WIDTH):
            byte = lay.bytes[place + j]
            g["filters"][j] = p["emb"][byte].T @ d_z
            g["emb"] += _conv.by_byte(byte, d_z @ p["filters"][j].T)
        return g


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Net:
    """docs(doc_id, text), labels(doc_id, label 0/1)."""
    sample = _conv.training_rows(docs, labels, rows, max_bytes)
    return Net().fit([t for _, t, _ in sample], [int(v) for _, _, v in sample])


def classify(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _text.chunks(batch.column(2), 1 << 17):
                score = net.score(c)
                part = slice(c.rows.start, c.rows.stop)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _conv.held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return classify(docs, train(docs, labels))
