"""Best-fit packing of tokenised documents into fixed-length sequences by minimum bin slack.

Documents become token ids plus one end id. Only those longer than a sequence are cut, into full sequences; the first
piece holds the remainder and may be shorter. What has to be packed is then a histogram: how many pieces there are of
each of at most `length` lengths. Bin by bin, the largest length left is placed and a bitset subset-sum dynamic programme
over the available lengths (with their multiplicities) finds the fullest feasible combination for the rest of the bin,
which is removed; the same combination stays the best as long as its lengths last, so it is taken that often at once.
The search therefore sees only the histogram and makes a few thousand steps at most, whatever the number of pieces.

A piece finds its bin by its rank among the pieces of its length. Ranks come from counts of salted cells and row numbers
inside a cell, so a length that a third of all pieces share is not one task's work. Texts and ids are never shuffled
unless the caller carries ids along.

Tokenising: the rank file of the same vocabulary encodes texts of plain characters; other texts, and those with the
string of a special token, go to the tokenizer. The ids are the tokenizer's own, as it is loaded: a special token's
string in a text is that token.

Defined cases: a null or empty text is its end id alone; repeated rows are pieces of their own (cells are salted by a
row number, so equal rows are dealt over all of a length's cells); a null id is packed like any other; an empty table
packs into nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from panweave.llm._spark import Tables, read, tidy

LENGTH, END_ID = 1024, 2
SALTS = 256

# The vocabulary's splitting pattern, and the characters that are classed alike by every Unicode version.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-ɏ‐-‧‰-⁞€]")
#: Runs of white space that the splitting's backtracking may not hold.
RUN, LONG_RUN = 100_000, re.compile(r"(?<!\s)\s{100000}")


def tokenizer_paths() -> tuple[str, str]:
    """The default tokenizer and the rank file of the same vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Text -> ids as little-endian uint32 bytes.

    `ranks` names the same vocabulary as a rank file, which encodes the texts of plain characters. All others, those that
    hold the string of a special token or an endless run of white space, and without a rank file every text go to the
    tokenizer.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.path, self.ranks = path, None
        if ranks is None:
            return
        import tiktoken

        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", ())]
        with open(ranks, "rb") as f:
            order = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=order, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        """Loaded when a text first needs it: beside the ranks it would only take memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.added) or ODD.search(text) or (len(text) > RUN and LONG_RUN.search(text)):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return array("I", ids).tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path, ranks)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian uint32)."""
    if path is None:
        path, ranks = tokenizer_paths()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path, ranks)
        for batch in batches:
            ids, texts, n, held = batch.column(0), batch.column(1), batch.num_rows, 0
            rows, piece, start, size, blob = [], [], [], [], []
            for i in range(n):
                coded = encode(texts[i].as_py() or "") + end
                total = len(coded) // 4
                at, k = 0, 0
                while at < total:
                    step = total if total <= length else (total - at) % length or length
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(step)
                    blob.append(coded[4 * at : 4 * (at + step)])
                    at, k = at + step, k + 1
                held += len(coded)
                if held > 1 << 20 or i == n - 1:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(blob, pa.binary())],
                                                     names=["doc_id", "piece", "start", "length", "ids"])
                    rows, piece, start, size, blob, held = [], [], [], [], [], 0

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids binary")


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most `room`: {length: how many}.

    Bit s of a stage's set says that the lengths up to that stage can sum to s. Long lengths come first, so the short
    ones, which fit anywhere, are kept for later; a combination that fills the room ends the search.
    """
    full, mask = 1 << room, (1 << (room + 1)) - 1
    reach, stages = 1, []
    for size in sorted((s for s in counts if s <= room and counts[s]), reverse=True):
        most = min(counts[size], room // size)
        before, left, step = reach, most, 1
        while left:  # 1, 2, 4, ... copies at once reach every number up to `most`
            take = min(step, left)
            reach |= (reach << (size * take)) & mask
            left -= take
            step *= 2
        stages.append((size, most, before))
        if reach & full:
            break
    best = reach.bit_length() - 1
    found: dict[int, int] = {}
    for size, most, before in reversed(stages):
        k = 0
        while not (before >> best) & 1:
            best -= size
            k += 1
            assert k <= most
        if k:
            found[size] = k
    return found


def plan_bins(counts: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Stretches (length, first rank, first bin, pieces per bin, first offset) and the number of bins."""
    left = {s: n for s, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    bins, out = 0, []
    while left:
        top = max(left)
        left[top] -= 1
        combo = fullest(length - top, left)
        left[top] += 1
        combo[top] = combo.get(top, 0) + 1
        times = min(left[s] // k for s, k in combo.items())
        offset = 0
        for size in sorted(combo, reverse=True):
            k = combo[size]
            out.append((size, used[size], bins, k, offset))
            offset += k * size
            used[size] += k * times
            left[size] -= k * times
            if not left[size]:
                del left[size]
        bins += times
    return out, bins


def assign(tables: Tables, rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rows(_row, length, ...) with sequence_id and offset in place of _row; other columns ride along.

    `rows` should be a written table, since it is read for the counts and again for the ranks; _row numbers its rows.
    """
    cells = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    counts = tables.save(cells.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # `length` rows at most
    stretches, _ = plan_bins(histogram, length)
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    order = W.partitionBy("length", "_salt").orderBy("_row")
    ranked = cells.withColumn("_within", F.row_number().over(order) - 1).join(starts, ["length", "_salt"])
    names = [c for c in rows.columns if c != "_row"]
    ranked = ranked.select(*names, (F.col("_begin") + F.col("_within")).alias("_rank"))
    plan = np.array(sorted(stretches), np.int64).reshape(-1, 5)
    edge = plan[:, 0] * (1 << 48) + plan[:, 1]
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            row = plan[np.searchsorted(edge, size * (1 << 48) + rank, side="right") - 1]
            turn = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(row[:, 2] + turn // np.maximum(row[:, 3], 1)), pa.array(row[:, 4] + turn % np.maximum(row[:, 3], 1) * size)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for)."""
    tables = Tables(docs.sparkSession, "pack")
    cut = pieces(docs, id_col, text_col, path, ranks, length, end_id).withColumn("ids_crc32", F.crc32("ids"))
    narrow = tables.save(cut.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])))
    return assign(tables, narrow, length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
