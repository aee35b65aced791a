"""Language identification: a byte convolutional network over fixed-length windows, trained in numpy.

A text is cut into windows of WINDOW bytes that cover all of it. Filters of several widths run over the bytes of a
window, each is rectified and max-pooled over the window, and a softmax layer gives the languages' probabilities. A
document's score is the mean over its windows, weighted by their bytes; the best language wins.

Training takes at most TRAIN_ROWS labelled documents outside the held-out fifth, of at most TRAIN_BYTES bytes each, and
draws windows from them anew in each epoch. Only text enters a prediction.

Defined cases: null texts and texts without a letter are `und` with score 0; without labelled rows everything is `und`;
repeated rows get equal answers; a null id counts as held out; other columns are ignored; a very long text is worked on
in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panweave.llm import _conv, _text
from panweave.llm._spark import read, tidy

WINDOW, DEPTH, WIDTHS, FILTERS = 256, 8, (2, 3, 4, 5), 10
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, BATCH, RATE, SEED = 3000, 16_384, 16, 64, 8e-3, 5
MIN_STEPS = 1500  # a small sample is passed over more often
PER_DOC = 3  # windows drawn from a document in an epoch
PIECE = 256  # windows
UNKNOWN = "und"


class Net:
    def __init__(self, languages: list[str], seed: int = SEED):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"emb": r.normal(0, 0.5, (256, DEPTH)), "out": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), "out_bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"f{w}"] = r.normal(0, 0.5, (w, DEPTH, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)

    def _looked(self) -> tuple[np.ndarray, np.ndarray]:
        """All filters as taps of the widest one: the narrower ones add nothing at its last taps."""
        wide = np.zeros((max(WIDTHS), 256, FILTERS * len(WIDTHS)), np.float32)
        for k, w in enumerate(WIDTHS):
            wide[:w, :, k * FILTERS : (k + 1) * FILTERS] = _conv.tables(self.p["emb"], self.p[f"f{w}"])
        return wide, np.concatenate([self.p[f"b{w}"] for w in WIDTHS]).astype(np.float32)

    def _pool(self, data: np.ndarray, valid: np.ndarray, looked: tuple[np.ndarray, np.ndarray], where: bool = False):
        """Maxima of the filters over each window (and their places)."""
        n = len(valid)
        z = _conv.convolve(data, n * WINDOW, *looked).reshape(n, WINDOW, -1)
        for s in np.flatnonzero(valid < WINDOW).tolist():
            z[s, valid[s] :] = 0
        if not where:
            return z.max(axis=1).astype(np.float64), None
        place = z.argmax(axis=1)
        return np.take_along_axis(z, place[:, None, :], axis=1)[:, 0].astype(np.float64), place

    def _soft(self, pooled: np.ndarray) -> np.ndarray:
        logit = pooled @ self.p["out"] + self.p["out_bias"]
        e = np.exp(logit - logit.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def score(self, chunk: _text.Chunk) -> np.ndarray:
        """(documents, languages): mean probabilities over the windows."""
        lay = _conv.Layout(chunk, WINDOW)
        prob, looked = np.empty((len(lay), len(self.languages))), self._looked()
        for a in range(0, len(lay), PIECE):
            b = min(len(lay), a + PIECE)
            prob[a:b] = self._soft(self._pool(lay.bytes[a * WINDOW : b * WINDOW + _conv.HALO], lay.valid[a:b], looked)[0])
        weight = lay.valid.astype(np.float64)
        weight[lay.first[:-1]] = np.maximum(weight[lay.first[:-1]], 1)
        return np.add.reduceat(prob * weight[:, None], lay.first[:-1], axis=0) / np.add.reduceat(weight, lay.first[:-1])[:, None]

    def fit(self, texts: list[str], labels: list[str], epochs: int = EPOCHS) -> Net:
        if not texts:
            return self
        r = np.random.default_rng(SEED)
        raw = [t.encode() for t in texts]
        target = np.array([self.languages.index(v) for v in labels])
        opt, epochs = _conv.Adam(self.p, RATE), max(epochs, -(-MIN_STEPS * BATCH // (PER_DOC * len(raw))))
        for epoch in range(epochs):
            opt.rate = RATE * (1 - epoch / epochs) ** 0.5
            doc = r.permutation(np.repeat(np.arange(len(raw)), PER_DOC))
            for a in range(0, len(doc), BATCH):
                own = doc[a : a + BATCH]
                data, valid = np.zeros(len(own) * WINDOW + _conv.HALO, np.uint8), np.zeros(len(own), np.int64)
                for k, d in enumerate(own.tolist()):
                    begin = int(r.integers(0, max(1, len(raw[d]) - WINDOW // 2)))
                    size = WINDOW if r.random() < 0.7 else int(r.integers(16, WINDOW // 2))  # short texts are learnt too
                    part = raw[d][begin : begin + size]
                    data[k * WINDOW : k * WINDOW + len(part)] = np.frombuffer(part, np.uint8)
                    valid[k] = len(part)
                opt.step(self._grads(data, valid, target[own]))
        return self

    def _grads(self, data: np.ndarray, valid: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled, at = self._pool(data, valid, self._looked(), where=True)
        d_logit = self._soft(pooled)
        d_logit[np.arange(len(y)), y] -= 1
        d_logit /= len(y)
        g = {"out": pooled.T @ d_logit + 1e-4 * self.p["out"], "out_bias": d_logit.sum(axis=0), "emb": np.zeros_like(self.p["emb"])}
        d_pool = (d_logit @ self.p["out"].T) * (pooled > 0)
        for k, w in enumerate(WIDTHS):
            d = d_pool[:, k * FILTERS : (k + 1) * FILTERS]
            place = (np.arange(len(y))[:, None] * WINDOW + at[:, k * FILTERS : (k + 1) * FILTERS]).ravel()
            g[f"b{w}"] = d.sum(axis=0)
            g[f"f{w}"] = np.zeros_like(self.p[f"f{w}"])
            flat, which = d.ravel(), np.tile(np.arange(FILTERS), len(y))
            for j in range(w):
                byte = data[place + j]
                g[f"f{w}"][j] = (self.p["emb"][byte] * flat[:, None]).reshape(len(y), FILTERS, DEPTH).sum(axis=0).T
                g["emb"] += _conv.by_byte(byte, flat[:, None] * self.p[f"f{w}"][j].T[which])
        return g


def train(docs: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Net:
    """docs(doc_id, text, lang)."""
    sample = _conv.training_rows(docs.select("doc_id", "text"), docs.select("doc_id", F.col("lang").alias("label")), rows, max_bytes)
    sample = [(t, v) for _, t, v in sample if any(map(str.isalpha, t))]
    return Net(sorted({v for _, v in sample})).fit([t for t, _ in sample], [v for _, v in sample])


def has_letter(column):
    """Whether a text has a letter of any script (Unicode L)."""
    return F.coalesce(column.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, and the columns of `keep` as keep_0, keep_1, ..."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for c in _text.chunks(batch.column(2), 1 << 17):
                part = slice(c.rows.start, c.rows.stop)
                known = batch.column(3)[part].to_numpy(zero_copy_only=False).astype(bool)
                if net.languages:
                    prob = net.score(c)
                    best, score = prob.argmax(axis=1), prob.max(axis=1)
                else:
                    known = np.zeros(len(c), bool)
                    best, score = np.zeros(len(c), np.int64), np.zeros(len(c))
                best, score = np.where(known, best, len(net.languages)), np.where(known, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(1)[part], pa.array(names[best].tolist(), pa.string()), pa.array(score), *[batch.column(at)[part] for at in places]],
                    names=["doc_id", "held_out", "lang_pred", "score", *[f"keep_{k}" for k in range(len(keep))]])

    # the text goes to the workers once, also if it is kept
    others = [c for c in keep if c != text_col]
    places = [2 if c == text_col else 4 + others.index(c) for c in keep]
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _conv.held_out(F.col(id_col)).alias("held_out"), text.alias("text"), has_letter(text).alias("letter"), *[F.col(c).alias(f"other_{k}") for k, c in enumerate(others)])
    kinds = [rows.schema["text"].dataType if c == text_col else rows.schema[f"other_{others.index(c)}"].dataType for c in keep]
    fixed = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(run), T.StructType([*fixed.fields, *[T.StructField(f"keep_{k}", kind) for k, kind in enumerate(kinds)]]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))
