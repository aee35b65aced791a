"""Byte convolutions in numpy: a padded layout of many documents, table look-ups, Adam, and training samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panweave.llm import _text

HALO = 8  # bytes of padding after the last block, for filters that look ahead


class Layout:
    """Documents of a chunk, each padded with zero bytes to whole blocks; an empty document has one empty block.

    Document i has blocks[i] blocks from first[i] on. At least HALO zero bytes follow its text, if need be in one more
    block that isn't its own, so that no filter looks into the next document.
    """

    def __init__(self, chunk: _text.Chunk, block: int):
        sizes = np.diff(chunk.bounds)
        self.block = block
        self.blocks = np.maximum(1, -(-sizes // block))
        padded = np.maximum(1, -(-(sizes + HALO) // block))
        self.first = np.concatenate(([0], np.cumsum(padded)))
        total = int(self.first[-1])
        self.bytes = np.zeros(total * block + HALO, np.uint8)
        self.bytes[np.repeat(self.first[:-1] * block - chunk.bounds[:-1], sizes) + np.arange(len(chunk.data))] = chunk.data
        within = np.arange(total) - np.repeat(self.first[:-1], padded)
        self.valid = np.clip(np.repeat(sizes, padded) - within * block, 0, block)

    def __len__(self) -> int:
        return len(self.valid)


def tables(embedding: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """(256, d) and (width, d, f) -> (width, 256, f): what each byte adds at each tap."""
    return np.einsum("bd,wdf->wbf", embedding, filters).astype(np.float32)


def convolve(data: np.ndarray, n: int, looked: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter responses at the first n positions, rectified; cut in stretches that stay in the processor's cache."""
    out = np.empty((n, looked.shape[2]), np.float32)
    step = 4096
    spare = np.empty((min(n, step), looked.shape[2]), np.float32)
    first = looked[0] + bias
    for a in range(0, n, step):
        b = min(n, a + step)
        part = out[a:b]
        np.take(first, data[a:b], axis=0, out=part, mode="clip")
        for j in range(1, len(looked)):
            part += np.take(looked[j], data[a + j : b + j], axis=0, out=spare[: b - a], mode="clip")
        np.maximum(part, 0, out=part)
    return out


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def by_byte(data: np.ndarray, grads: np.ndarray) -> np.ndarray:
    """Sums of the rows of grads by byte value: the gradient of an embedding look-up."""
    return np.stack([np.bincount(data, grads[:, k], 256) for k in range(grads.shape[1])], axis=1)


def held_out(doc_id: Column) -> Column:
    """One document in five, by its id's CRC-32, is never learnt from; a null id is held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labelled: DataFrame, rows: int, max_bytes: int) -> list[tuple[int, str, object]]:
    """(doc_id, text, label) of at most `rows` labelled texts of at most `max_bytes` bytes, chosen by hash of the id.

    The ids come from the narrow label table alone: at most `rows` of them, which is what the broadcast holds. One scan
    joins their texts, and of those again at most `rows` reach the driver: rows * max_bytes whatever the input. An id
    with several labels or texts gives each pair of them.
    """
    picked = labelled.filter(~held_out(F.col("doc_id")) & F.col("label").isNotNull()).select("doc_id", "label")
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "label").limit(rows).distinct()
    fit = docs.filter(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)).select("doc_id", "text")
    pairs = fit.join(F.broadcast(picked), "doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "label", "text").limit(rows)
    return sorted((r["doc_id"], r["text"], r["label"]) for r in pairs.collect())
