"""Coding sequences of transcripts: open reading frames, consensus of two predictions, longest common substring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panweave.functions.sequences import CODONS

_TURN = str.maketrans("acgtACGT", "tgcaTGCA")


def translate(dna: str) -> str:
    dna = dna.upper().replace("U", "T")
    return "".join(CODONS.get(dna[i : i + 3], "X") for i in range(0, len(dna) - 2, 3))


def open_frames(seq: str, least: int) -> list[tuple[int, int, int, str, str]]:
    """(strand, start, end, type, protein) of every reading frame of at least `least` residues; places on the strand given.

    complete: starts with M and ends with a stop; 5prime: runs in from the left end; 3prime: runs out at the right;
    internal: both ends open.
    """
    out = []
    for strand, s in ((1, seq), (-1, seq[::-1].translate(_TURN))):
        for frame in range(3):
            protein, at = translate(s[frame:]), 0
            parts = protein.split("*")
            for k, part in enumerate(parts):
                stop = k < len(parts) - 1
                met = part.find("M")
                open_left = k == 0
                begin = met if met >= 0 and not open_left else 0 if open_left else None
                if begin is not None and len(part) - begin >= least:
                    full = begin == met
                    kind = ("complete" if stop else "3prime") if full else ("5prime" if stop else "internal")
                    first = frame + 3 * (at + begin)
                    last = frame + 3 * (at + len(part) + stop)
                    a, b = (first + 1, last) if strand == 1 else (len(seq) - last + 1, len(seq) - first)
                    out.append((strand, a, b, kind, part[begin:]))
                at += len(part) + 1
    return sorted(out, key=lambda x: (-len(x[4]), -x[0], x[1]))


def orfs(seqs: DataFrame, least: int = 50, longest_only: bool = False) -> DataFrame:
    """(seq_id, strand, start, end, type, protein) of all reading frames, or of the longest one of each sequence."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(i, *f) for i, s in zip(p.seq_id, p.seq, strict=True) for f in open_frames(s or "", least)[: 1 if longest_only else None]]
            yield pd.DataFrame(rows, columns=["seq_id", "strand", "start", "end", "type", "protein"])

    return seqs.select("seq_id", "seq").mapInPandas(run, "seq_id long, strand int, start int, end int, type string, protein string")


def _codes(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.int64) for x in (a, b))


def _by_cells(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """A row of the table of common suffixes at a time, with wildcards: * in the first, N in the second."""
    best, row = (0, 0, 0), np.zeros(len(y) + 1, np.int64)
    free = y == ord("N")
    for i, c in enumerate(x.tolist()):
        row[1:] = np.where((y == c) | free | (c == ord("*")), row[:-1] + 1, 0)
        j = int(row.argmax())
        if row[j] > best[0]:
            best = int(row[j]), i + 1 - int(row[j]), j - int(row[j])
    return best


#: Cells of the tables of common suffixes that a batch holds at most; longer pairs are taken one by one.
CELLS = 1 << 22


def _padded(texts: list[str], fill: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), fill, np.int32)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    return out


def longest_common_of(firsts: list[str], seconds: list[str]) -> list[tuple[int, int, int]]:
    """longest_common() with wildcards of many pairs, none empty: rows of all pairs' tables at a time, ties alike."""
    found: list[tuple[int, int, int]] = [(0, 0, 0)] * len(firsts)
    order = sorted(range(len(firsts)), key=lambda k: len(seconds[k]))
    at = 0
    while at < len(order):
        longest, upto = 0, at
        while upto < len(order) and (upto + 1 - at) * max(longest, len(firsts[order[upto]]), len(seconds[order[upto]])) * 4 <= CELLS:
            longest, upto = max(longest, len(firsts[order[upto]]), len(seconds[order[upto]])), upto + 1
        if upto - at < 2:  # too long to share a batch
            k = order[at]
            found[k] = longest_common(firsts[k], seconds[k], True)
            at += 1
            continue
        some = order[at:upto]
        x, y = _padded([firsts[k] for k in some], -1), _padded([seconds[k] for k in some], -2)
        inside, free = y != -2, y == ord("N")
        n, pair = len(some), np.arange(len(some))
        row, best, i_of, j_of = np.zeros((n, y.shape[1] + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for i in range(x.shape[1]):
            c = x[:, i, None]
            met = ((y == c) | ((free | (c == ord("*"))) & (c != -1))) & inside
            new = np.where(met, row[:, :-1] + 1, 0)
            row[:, 1:] = new
            j = new.argmax(axis=1)
            top = new[pair, j]
            more = top > best
            best[more], i_of[more], j_of[more] = top[more], i + 1 - top[more], j[more] + 1 - top[more]
        for k, *place in zip(some, best.tolist(), i_of.tolist(), j_of.tolist(), strict=True):
            found[k] = tuple(place)
        at = upto
    return found


def longest_common(a: str, b: str, wild: bool = False) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the longest common substring, the first in a, then in b, on ties.

    Both are numbered together by prefix doubling: runs of 2 ** k letters are equal if their numbers are, so runs of any
    length are equal if two overlapping ones are, and the length is found by bisection. wild: * in a and N in b stand for
    any letter; then the table of common suffixes is gone through a row at a time.
    """
    if not a or not b:
        return 0, 0, 0
    x, y = _codes(a, b)
    if wild and ("*" in a or "N" in b):
        return _by_cells(x, y)
    text = np.concatenate((x, [-1], y, [-2]))
    ranks, n = [np.unique(text, return_inverse=True)[1]], len(x)
    most = min(n, len(y))
    while 2 << (len(ranks) - 1) <= most:
        half, w = ranks[-1], 1 << (len(ranks) - 1)
        key = half[:-w] * (len(text) + 1) + half[w:]
        ranks.append(np.unique(key, return_inverse=True)[1])

    def places(length: int) -> tuple[np.ndarray, np.ndarray]:
        k = length.bit_length() - 1
        r = ranks[k]
        end = len(text) - length + 1
        key = r[:end] * (len(text) + 1) + r[length - (1 << k) : length - (1 << k) + end]
        return key[: n - length + 1], key[n + 1 : n + 1 + len(y) - length + 1]

    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if np.isin(*places(mid)).any() else (low, mid - 1)
    if not low:
        return 0, 0, 0
    left, right = places(low)
    i = int(np.flatnonzero(np.isin(left, right))[0])
    return low, i, int(np.flatnonzero(right == left[i])[0])


def cds_consensus(first: str, second: str, labels: tuple[str, str] = ("first", "second"), priority: int = 1, overlap: int = 90) -> tuple[str, str]:
    """Two predictions of one coding sequence as one, and how it came about.

    With a common stretch of at least `overlap` letters: one goes on where the other ends (`a.b`), or holds the other
    (`a<b`), or they differ beside it (`-mismatches`); without, `-noover`. In the last two cases the one of priority (1 or
    2) stands. N in the second and * in the first match any letter.
    """
    return _consensus(first, second, longest_common(first, second, True), labels, priority, overlap)


def _consensus(first: str, second: str, common: tuple[int, int, int], labels: tuple[str, str], priority: int, overlap: int) -> tuple[str, str]:
    (n, i, j), (one, two) = common, labels
    if n >= overlap and n:
        if i + n == len(first) and j == 0:
            return first[:i] + second, f"{one}.{two}"
        if i == 0 and j + n == len(second):
            return second + first[n:], f"{two}.{one}"
        if j == 0 and j + n == len(second):
            return first, f"{one}<{two}"
        if i == 0 and i + n == len(first):
            return second, f"{two}<{one}"
    note = "mismatches" if n >= overlap and n else "noover"
    return (first, f"{one}-{note}") if priority == 1 else (second, f"{two}-{note}")


def consensus(first: str, second: str, overlap: int) -> str:
    """The sequence of cds_consensus() in which the first has priority; one that is empty gives way to the other."""
    return cds_consensus(first, second, overlap=overlap)[0] if first and second else first or second


def consensus_of(pairs: DataFrame, labels: tuple[str, str] = ("transdecoder", "blastx"), priority: int = 2, overlap: int = 90) -> DataFrame:
    """pairs(id, first, second) -> (id, seq, evidence); a null prediction leaves the other as it is, without evidence.

    Pairs are dealt anew, since a small file of them is otherwise one task's work.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = list(zip(p["first"], p["second"], strict=True))
            whole = [k for k, (a, b) in enumerate(texts) if a and b]
            rows: list[tuple] = [(a or b, None) for a, b in texts]
            for k, common in zip(whole, longest_common_of([texts[k][0] for k in whole], [texts[k][1] for k in whole]), strict=True):
                rows[k] = _consensus(*texts[k], common, labels, priority, overlap)
            yield pd.DataFrame([(i, *r) for i, r in zip(p.id, rows, strict=True)], columns=["id", "seq", "evidence"])

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select("id", "first", "second").repartition(n, F.xxhash64("id", "first", "second"))
    return dealt.mapInPandas(run, f"id {pairs.schema['id'].dataType.simpleString()}, seq string, evidence string")
