"""Periodic runs of words by the suffix tree of Stoye and Gusfield.

A run is a stretch of words with smallest period q, at least MIN_LENGTH words and MIN_POWER periods long, which no
neighbouring word extends. Its rightmost square starts a branching tandem repeat: at i = end - 2q the suffixes i and i + q
agree in exactly q words, so they hang below two children of a node of depth q. These repeats are found in the suffix tree
by listing, at every node, the leaves of all children but the largest (a leaf is listed log n times at most) and asking
for each leaf i whether i + q or i - q is a leaf of the same node; rotating a repeat to the left as far as words agree
gives its run, and repeats that give one run are merged under the smallest period.

The trees of a chunk of whole documents are built together, as arrays: suffixes sorted by prefix doubling, the lengths of
their common prefixes compared word by word only where they don't follow from the place before, and the nodes from the
nearest smaller of these lengths. Words are numbered by a dictionary, so words are equal only if their bytes are. A run
has two suffixes that agree in 16 words (a run of period q in max(24 - q, 2q) of them), so documents in which no 16 words
come twice, known after four doublings, have no run and no tree.

Defined cases: a null, empty or wordless text has no words and no run; with a null id nothing is planted by the query;
repeated rows are judged alike; of runs with the greatest exponent the first is returned, then the shorter period; other
columns are ignored. A very long text is a chunk of its own and takes about 190 bytes a word (40 MB of text: 1.3 GB).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panweave.llm import _text
from panweave.llm._spark import read, tidy

MIN_LENGTH, MIN_POWER = 24, 3
#: Elements that a block of compared words, or a slice of listed leaves, has at most.
SLICE = 1 << 18

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"

#: (id, number of words) -> the words' new order, or None for the order as it is
Plant = Callable[[int | None, int], np.ndarray | None]


def agreement(t: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many elements agree from a and b on, forwards (step 1) or backwards (-1); t ends and begins with unique ones."""
    out = np.zeros(len(a), np.int64)
    for part in range(0, len(a), SLICE // 4):
        live, w = np.arange(part, min(len(a), part + SLICE // 4)), 4
        while len(live):
            offset = out[live][:, None] + np.arange(w)
            x, y = a[live][:, None] + step * offset, b[live][:, None] + step * offset
            same = t[np.clip(x, 0, len(t) - 1)] == t[np.clip(y, 0, len(t) - 1)]
            whole = same.all(axis=1)
            out[live] += np.where(whole, w, same.argmin(axis=1))
            live = live[whole]
            w = max(4, min(2 * w, SLICE // max(1, len(live))))
    return out


def suffixes(t: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes of the documents in which `least` (a power of two) elements come twice, and those documents.

    Elements of different documents are never equal and each document ends with one that it has once.
    """
    n = len(t)
    sa = np.argsort(t, kind="stable")
    head = np.concatenate(([True], t[sa][1:] != t[sa][:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))
    k, docs = 1, np.zeros(0, doc.dtype)
    while len(slots):
        if k == least:
            docs = np.unique(doc[sa[slots]])
        at = sa[slots]
        key = rank[at] * (n + 1) + rank[at + k]  # two suffixes that agree in k words don't end there
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        head = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        slots = slots[~(head & np.concatenate((head[1:], [True])))]
        k *= 2
    return sa[np.isin(doc[sa], docs)], docs


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[j] of suffixes j - 1 and j of the order; 0 at both ends of the array of len(sa) + 1.

    Where the words before both suffixes agree, the length is that of the place before, less one; only at the other places
    words are compared, n log n of them at most.
    """
    place, before = sa[1:], sa[:-1]
    given = t[place - 1] == t[before - 1]
    own = np.full(len(t) + 1, -1, np.int64)  # by place: where its length is counted from
    length = np.zeros(len(t) + 1, np.int64)
    some = np.flatnonzero(~given)
    length[place[some]] = agreement(t, place[some], before[some], 1)
    own[place[some]] = place[some]
    own = np.maximum.accumulate(own)
    out = np.zeros(len(sa) + 1, np.int64)
    out[1:-1] = length[own[place]] - (place - own[place])
    return out


def _smaller_before(v: np.ndarray) -> np.ndarray:
    """For every element the last place before it with a smaller value; the first place, where there is none."""
    v = np.append(-1, v[1:])
    p = np.arange(len(v)) - 1
    p[0] = 0
    todo = 1 + np.flatnonzero(v[p[1:]] >= v[1:])
    while len(todo):
        p[todo] = p[p[todo]]
        todo = todo[v[p[todo]] >= v[todo]]
    return p


def branching_repeats(t: np.ndarray, sa: np.ndarray, rotate: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching tandem repeats; with rotate, of those that rotate, whose last word also stands
    before them."""
    m = len(sa)
    lcp = common_prefixes(t, sa)
    left, right = _smaller_before(lcp), m - _smaller_before(lcp[::-1])[::-1]
    inner = np.flatnonzero(lcp > 0)
    inner = inner[np.lexsort((inner, right[inner], left[inner]))]  # a node is an interval of the order
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = left[inner], right[inner]
    new = np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    node, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    # children: from the node's left end to its first border, from border to border, and to its right end
    tails = np.append(heads[1:], len(inner))
    start, end = np.insert(inner, heads, lo[heads]), np.insert(inner, tails, hi[heads])
    of = np.insert(node, heads, np.arange(len(heads)))
    size = end - start
    by_size = np.lexsort((-size, of))
    small = np.ones(len(size), bool)
    small[by_size[np.searchsorted(of, np.arange(len(heads)))]] = False
    start, size, of = start[small], size[small], of[small]
    rank = np.full(len(t) + 1, -1, np.int64)
    rank[sa] = np.arange(m)
    begins, periods = [], []
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        n = size[at:upto]
        leaf = sa[np.repeat(start[at:upto] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        which = heads[np.repeat(of[at:upto], n)]
        depth, first, last = lcp[inner[which]], lo[which], hi[which]
        ahead = rank[leaf + depth]
        ok = (ahead >= first) & (ahead < last)
        back = np.maximum(leaf - depth, 0)
        behind = rank[back]
        ok2 = (behind >= first) & (behind < last) & (leaf >= depth)
        begin, period = np.concatenate((leaf[ok], back[ok2])), np.concatenate((depth[ok], depth[ok2]))
        good = t[begin + period] != t[begin + 2 * period]
        if rotate:
            good &= t[begin - 1] == t[begin - 1 + period]
        begins.append(begin[good])
        periods.append(period[good])
        at = upto
    begin, period = np.concatenate(begins), np.concatenate(periods)
    order = np.lexsort((period, begin))
    begin, period = begin[order], period[order]
    once = np.concatenate(([True], (begin[1:] != begin[:-1]) | (period[1:] != period[:-1]))) if len(begin) else np.zeros(0, bool)
    return begin[once], period[once]


def rotated(t: np.ndarray, begin: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (start, end, smallest period) of branching repeats, each rotated to the left as far as words agree.

    Repeats with one end are taken by rising period: one that lies in the run of a smaller period is that run with a
    multiple of its period, and goes.
    """
    end = begin + 2 * period
    order = np.lexsort((period, end))
    begin, period, end = begin[order], period[order], end[order]
    out = []
    while len(begin):
        head = np.concatenate(([True], end[1:] != end[:-1]))
        b, q = begin[head], period[head]
        start = b - agreement(t, b - 1, b - 1 + q, -1)
        out.append((start, end[head], q))
        rest = ~head & (begin < start[np.cumsum(head) - 1])
        begin, period, end = begin[rest], period[rest], end[rest]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def runs_of(t: np.ndarray, doc: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, by start, then period. t: a unique element, then each document's words and
    an element of its own; words of different documents differ."""
    agree = min(max(min_length - q, (min_power - 1) * q) for q in range(1, min_length + 1))
    sa, _ = suffixes(t, doc, 1 << max(0, agree.bit_length() - 1))
    if not len(sa):
        return (np.zeros(0, np.int64),) * 3
    start, end, period = rotated(t, *branching_repeats(t, sa, min_power > 2))
    long = (end - start >= min_length) & (end - start >= min_power * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _dictionary(data: np.ndarray, w: _text.Words) -> np.ndarray:
    """A number a word, equal for equal bytes."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    ink = ~_text._IS_SPACE[data]
    offsets = np.concatenate(([0], np.cumsum(w.end - w.start)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(offsets), pa.py_buffer(data[ink])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, order: np.ndarray) -> Iterator[bytes]:
    """The words of that order joined by one space, in pieces."""
    for at in range(0, len(order), 1 << 14):
        some = order[at : at + (1 << 14)]
        size = end[some] - start[some] + 1  # and a space before each
        place = np.repeat(start[some] - 1 - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        out = data[np.maximum(place, 0)]
        out[np.concatenate(([0], np.cumsum(size)[:-1]))] = 0x20
        yield out[1 if at == 0 else 0 :].tobytes()


def _document_runs(chunk: _text.Chunk, ids: list, plant: Plant | None, min_length: int, min_power: int) -> Iterator[tuple]:
    w = _text.words(chunk.data, chunk.bounds)
    code = _dictionary(chunk.data, w)
    per_doc, n_docs = w.per_doc, len(chunk)
    orders: list[np.ndarray | None] = [plant(i, int(n)) if plant else None for i, n in zip(ids, per_doc.tolist(), strict=True)]
    for k, order in enumerate(orders):
        if order is not None:
            a, b = w.bounds[k], w.bounds[k + 1]
            code[a:b] = code[a:b][order]
    # a unique element in front, and one after each document
    doc = np.repeat(np.arange(n_docs), per_doc + 1)
    first = 1 + w.bounds[:-1] + np.arange(n_docs)
    t = np.empty(len(doc) + 1, np.int64)
    vocabulary = int(code.max(initial=0)) + 1
    last = first + per_doc
    own = np.ones(len(t), bool)
    own[0] = own[last] = False
    t[own] = code
    t[last] = vocabulary
    t[1:] += doc * (vocabulary + 1)
    t[0] = n_docs * (vocabulary + 1)
    start, length, period = runs_of(t, np.concatenate(([n_docs], doc)), min_length, min_power)
    cuts = np.searchsorted(start, np.append(first, len(t)))
    for k in range(n_docs):
        a, b = w.bounds[k], w.bounds[k + 1]
        order = np.arange(b - a) if orders[k] is None else orders[k]
        found = list(zip((start[cuts[k] : cuts[k + 1]] - first[k]).tolist(), length[cuts[k] : cuts[k + 1]].tolist(), period[cuts[k] : cuts[k + 1]].tolist(), strict=True))
        dropped = 0
        if found:
            change = np.zeros(b - a + 1, np.int64)
            for s, n, q in found:
                change[s + q] += 1
                change[s + n] -= 1
            keep = np.cumsum(change[:-1]) == 0
            dropped = int((~keep).sum())
            order = order[keep]
        text = hashlib.sha256()
        for piece in _joined(chunk.data, w.start[a:b], w.end[a:b], order):
            text.update(piece)
        best: tuple = (None, None, None)
        for s, n, q in found:
            if best[0] is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode())
        yield (ids[k], len(found), *best, 1000 * best[1] // best[2] if found else None, listed.hexdigest(), text.hexdigest(), int(b - a), dropped)


def _judge(plant: Plant | None, min_length: int, min_power: int, chunk_bytes: int):
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _text.chunks(batch.column(1), chunk_bytes):
                ids = batch.column(0).slice(chunk.rows.start, len(chunk)).to_pylist()
                rows = list(_document_runs(chunk, ids, plant, min_length, min_power))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_power: int = MIN_POWER, plant: Plant | None = None, chunk_bytes: int = 1 << 19) -> DataFrame:
    """One row per document: its number of runs, the strongest run, the digests of all runs and of the text without the
    repeated periods, n_words and n_dropped. min_power: 2 or more."""
    if min_power < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_judge(plant, min_length, min_power, chunk_bytes)), SCHEMA)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's periodic texts: in a tenth of the documents a stretch of words is repeated to the text's end."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    order = np.arange(n)
    order[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return order


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"), plant=planted)


ORACLE_SQL = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(i))),
d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295) AS h FROM documents, tab),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM g),
u AS (SELECT doc_id, n, i, w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] AS x FROM (SELECT *, len(w) AS n, unnest(range(len(w))) AS i FROM p)),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.x = y.x AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
f AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, s, n, min(q) AS q FROM f GROUP BY ALL),
b AS (SELECT doc_id, s, n, q FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n::DOUBLE / q DESC, s, q) AS k FROM r) WHERE k = 1),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY doc_id),
k AS (SELECT u.doc_id, u.i, any_value(u.x) AS x, count(r.s) AS gone FROM u LEFT JOIN r ON r.doc_id = u.doc_id AND u.i >= r.s + r.q AND u.i < r.s + r.n GROUP BY ALL),
c AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) FILTER (gone = 0) AS kept, count(*) FILTER (gone > 0) AS n_dropped FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.n::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.n // b.q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, len(d.w)::BIGINT AS n_words, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""
