"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

1. Each text gives its sorted set of 64-bit shingle hashes. One pass cuts the hash range into BANDS * ROWS bins and
   keeps each bin's smallest value; empty bins copy the bin that a fixed hash sequence of their number finds first.
2. Equal sets are one class with a number of its own. A text of its smallest document stands for it from here on.
3. A bucket is one band's value. Every bucket's smallest member is its centre, and the other members pair with it: a
   bucket of k members gives k - 1 candidate pairs. A member meets the same centre in many bands but is paired once.
4. Pairs are confirmed on the full sets. Where all members of a centre link to it there is nothing left to find: they
   are one component. Where some don't, two members of its buckets may still link to each other; such balls are
   compared within blocks of bounded size, the unlinked members against all, by an inverted index in memory. So every
   pair that shares a bucket is decided, and none is emitted but those that link (as the trees of a forest).
5. Components of the links.

With 21 bands of 6 rows a pair at the threshold 0.85 shares a bucket with probability 1 - (1 - 0.85**6)**21 > 0.9999.
Full sets are sets of 64-bit hashes. Words are hashed as polynomials over the field of 2**61 - 1 at a random base, so two
unlike words of b bytes meet with a probability of b / 2**61, however regular; windows of five are sums of such hashes
spread over 64 bits. Two sets of n and m shingles have a false match with a probability of about n * m * 5b / 2**61 (1e-8
for 20,000 shingles each of words of ten bytes); sets count as equal if their sizes and 128 bits of sums agree.

Defined cases: a null, empty or wordless text has an empty set, links with nothing and is kept; fewer than five words
make one shingle; a null id can't be named in a component, so its row is never compared, has a null component and is
kept; rows that repeat an id are compared each by its own text; ties go to the smallest id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panweave.llm import _text
from panweave.llm._graph import components, settle
from panweave.llm._spark import Tables, keyed_streams, read, runs, tidy

BANDS, ROWS = 21, 6
WIDTH = 5
PERCENT = 85
#: Shingles (8 bytes each) that one side of a block comparison may hold, about.
BLOCK_SHINGLES = 1 << 20
PROBES = 48

SIGNED = "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, bands array<long>"


def _probes(bins: int) -> np.ndarray:
    """probe[t, i]: the bin that empty bin i asks in its t-th attempt (a fixed universal hash of i and t)."""
    t, i = np.meshgrid(np.arange(PROBES, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    return (_text.mix(t * np.uint64(0x9E3779B97F4A7C15) + i * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) % np.uint64(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation MinHash of non-empty sorted sets, densified: (sets, bins) uint64."""
    edges = np.array([(i << 64) // bins for i in range(bins)] , dtype=np.uint64)
    sig = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for row, s in enumerate(sets):
        first = np.searchsorted(s, edges)
        last = np.append(first[1:], len(s))
        here = first < last
        sig[row, here] = s[first[here]]
        full[row] = here
    probe = _probes(bins)
    rows, cols = np.nonzero(~full)
    for t in range(PROBES):
        if not len(rows):
            return sig
        source = probe[t, cols]
        hit = full[rows, source]
        sig[rows[hit], cols[hit]] = sig[rows[hit], source[hit]]
        rows, cols = rows[~hit], cols[~hit]
    at = probe[PROBES - 1, cols]
    while len(rows):  # sets of very few shingles: walk on from the last probe
        at = (at + 1) % bins
        hit = full[rows, at]
        sig[rows[hit], cols[hit]] = sig[rows[hit], at[hit]]
        rows, cols, at = rows[~hit], cols[~hit], at[~hit]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.zeros((len(sig), bands), np.uint64)
    for k in range(rows):
        total += sig[:, k::rows][:, :bands] * _text._SHINGLE[k]
    return _text.mix(total ^ _text.mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :])


def _sums(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, as signed numbers: equal for equal sets."""
    k1 = [int(s.sum(dtype=np.uint64)) for s in sets]
    k2 = [int(_text.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets]
    return np.array(k1, np.uint64).view(np.int64), np.array(k2, np.uint64).view(np.int64)


def _sign(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _text.chunks(batch.column(1)):
                sets, _ = _text.shingle_sets(chunk, width)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                filled = [sets[i] for i in some]
                k1, k2 = (np.zeros(len(sets), np.int64) for _ in range(2))
                k1[some], k2[some] = _sums(filled)
                keys = band_keys(signatures(filled, bands * rows), bands, rows) if len(some) else np.zeros((0, bands), np.uint64)
                ends = np.zeros(len(sets) + 1, np.int32)
                np.cumsum(np.where(n > 0, bands, 0), out=ends[1:])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(chunk.rows.start, len(chunk)), batch.column(2).slice(chunk.rows.start, len(chunk)), pa.array(n), pa.array(k1, mask=n == 0), pa.array(k2, mask=n == 0),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
                ], names=["doc_id", "text_hash", "n_shingles", "k1", "k2", "bands"])
    return run


def _sets(width: int):
    """Rows (doc_id, text) -> the id, the two sums of the text's set, and the full set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _text.chunks(batch.column(1)):
                sets, _ = _text.shingle_sets(chunk, width)
                k1, k2 = _sums(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.rows.start, len(chunk)), pa.array(k1), pa.array(k2), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "k1", "k2", "shingles"])
    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int(np.count_nonzero(y[at] == x))


def _alike(common, nx, ny, percent: int):
    return 100 * common >= percent * (nx + ny - common)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, cs = batch.column(2), batch.column(3)
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, c = (np.frombuffer(v[i].as_buffer(), np.uint64) for v in (xs, cs))
                lo, hi = sorted((len(x), len(c)))
                linked[i] = 100 * lo >= percent * hi and _alike(_common(x, c), len(x), len(c), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], names=["centre", "member", "linked"])
    return run


def block_links(sets: list[np.ndarray], asks: np.ndarray, answers: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the sets at `asks` and those at `answers`: intersections by an inverted index over the latter."""
    size = np.array([len(s) for s in sets])
    pool = [sets[i] for i in answers]
    value, owner = np.concatenate(pool), np.repeat(np.arange(len(answers)), size[answers])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    a, b = [], []
    for i in asks:
        lo, hi = np.searchsorted(value, sets[i], "left"), np.searchsorted(value, sets[i], "right")
        n = hi - lo
        found = np.flatnonzero(n)
        n, lo = n[found], lo[found]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(answers))
        good = answers[_alike(common, size[i], size[answers], percent) & (common > 0)]
        good = good[good != i]
        a.append(np.full(len(good), i))
        b.append(good)
    return np.concatenate(a), np.concatenate(b)


def _balls(percent: int):
    """Rows (task, centre, member, linked, asks, answers, shingles), runs of a task together -> links as a forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "task", 4000):
            task = table["task"].to_numpy()
            member, linked = table["member"].to_numpy(), table["linked"].to_numpy()
            asks, answers = table["asks"].to_numpy(), table["answers"].to_numpy()
            blobs = table["shingles"]
            cuts = np.concatenate(([0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]))
            left, right = [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                q, r = np.flatnonzero(asks[lo:hi]), np.flatnonzero(answers[lo:hi])
                if hi - lo < 2 or not len(q) or not len(r):
                    continue
                sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in blobs.slice(lo, hi - lo)]
                a, b = block_links(sets, q, r, percent)
                tied = np.flatnonzero(linked[lo:hi])  # with the centre, so with each other
                one = np.full(max(0, len(tied) - 1), tied[0] if len(tied) else 0)
                root = settle(hi - lo, np.concatenate((a, one)), np.concatenate((b, tied[1:])))
                new = np.flatnonzero(root != np.arange(hi - lo))
                left.append(member[lo:hi][new])
                right.append(member[lo:hi][root[new]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text) and group_id.

    Rows have one group_id if they are of one component, also where they share an id with rows of another component; it
    is null for empty sets and null ids.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "minhash")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    signed = tables.save(texts.mapInArrow(tidy(_sign(bands, rows, width)), SIGNED))
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")

    # Classes of equal sets, by 128 bits of sums over their hashes and their size.
    first = usable.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = tables.save(first.withColumn("node", F.monotonically_increasing_id()))
    reps = usable.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2", "n_shingles", "node"), ["doc_id", "k1", "k2", "n_shingles"]).select("node", "bands")

    # Buckets and their stars. (Rows that repeat id and text repeat their class here; distinct() takes that back.)
    spots = reps.select(F.col("node").alias("member"), F.explode("bands").alias("bucket"))
    centres = spots.groupBy("bucket").agg(F.min("member").alias("centre"), F.max("member").alias("other")).filter("centre <> other").select("bucket", "centre")
    stars = tables.save(spots.join(centres, "bucket").filter("member <> centre").select("centre", "member").distinct())

    # Full sets of the documents in a star; confirmation of every centre-member pair.
    # The join with the texts takes the ids alone, the narrowest table there is, written so that its size is known. Which
    # of an id's texts is a class's own is settled on the sets' sums.
    wanted = stars.select(F.explode(F.array("centre", "member")).alias("node")).distinct()
    wanted = tables.save(classes.join(wanted, "node", "left_semi").select("rep", "node", "k1", "k2"))
    ids = tables.save(wanted.select(F.col("rep").alias("doc_id")).distinct())
    held = texts.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tidy(_sets(width)), "rep long, k1 long, k2 long, shingles binary")
    sets = tables.save(held.dropDuplicates(["rep", "k1", "k2"]).join(wanted, ["rep", "k1", "k2"]).select("node", "shingles"))
    member_sets = sets.select(F.col("node").alias("member"), "shingles")
    centre_sets = sets.select(F.col("node").alias("centre"), F.col("shingles").alias("centre_shingles"))
    pairs = stars.join(member_sets, "member").join(centre_sets, "centre").select("centre", "member", "shingles", "centre_shingles")
    judged = tables.save(pairs.mapInArrow(tidy(_confirm(percent)), "centre long, member long, linked boolean"))

    # Balls with members that don't link to their centre: those against all, in blocks.
    n = F.octet_length("shingles") / 8
    sized = judged.join(sets.select(F.col("node").alias("member"), n.alias("n")), "member")
    load = sized.groupBy("centre").agg(F.sum("n").alias("all_n"), F.sum(F.when(~F.col("linked"), F.col("n"))).alias("ask_n"), F.count(F.lit(1)).alias("size"))
    load = load.filter("ask_n IS NOT NULL AND size > 1").select(
        "centre", F.ceil(F.col("all_n") / block_shingles).cast("int").alias("q"), F.ceil(F.col("ask_n") / block_shingles).cast("int").alias("p"))
    part = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), "member"), F.col(k)).cast("int")
    spread = judged.join(load, "centre").withColumns({"i": part(1, "p"), "j": part(2, "q")})
    # a member answers in the tasks of its own answer block, and asks, if unlinked, in those of its own ask block
    role = lambda i, j, asks, answers: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), answers.alias("answers"))
    to_answer = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: role(i, F.col("j"), ~F.col("linked") & (i == F.col("i")), F.lit(True)))
    others = F.filter(F.sequence(F.lit(0), F.col("q") - 1), lambda j: j != F.col("j"))
    to_ask = F.transform(others, lambda j: role(F.col("i"), j, F.lit(True), F.lit(False)))
    placed = spread.withColumn("t", F.explode(F.when(F.col("linked"), to_answer).otherwise(F.concat(to_answer, to_ask))))
    placed = placed.select(F.xxhash64("centre", "t.i", "t.j").alias("task"), "member", "linked", "t.asks", "t.answers").join(member_sets, "member")
    found = keyed_streams(placed, "task").mapInArrow(tidy(_balls(percent)), "a long, b long")

    links = judged.filter("linked").select(F.col("centre").alias("a"), F.col("member").alias("b")).unionByName(found)
    parts = components(tables, links)
    least = parts.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    parts = parts.join(least, "component")
    named = tables.save(classes.join(parts, "node", "left").select("k1", "k2", "n_shingles", F.coalesce("least", "rep").alias("component_id"), F.coalesce("component", "node").alias("group_id")))
    out = signed.select("doc_id", "text_hash", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left")
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("component_id", "doc_id"))
    tables.drop(sets)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash", F.when(known, F.col("group_id")).alias("group_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY ALL),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY ALL)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""
