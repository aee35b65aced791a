"""Proteins of all six reading frames of many sequences: codons are looked up in a table, a sequence at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from panweave.functions.sequences import AMINO, BASES

FRAMES = "seq_id long, frame int, protein string"
#: Bytes of protein that a batch holds, about.
BATCH = 4 << 20


def _codes(bases: str) -> np.ndarray:
    """Number of each character's base, 64 where it is none; the last is for all characters beyond ASCII."""
    codes = np.full(129, 64, np.int16)
    for i, b in enumerate(bases):
        codes[[ord(b), ord(b.lower())]] = i
    return codes


_FORWARD, _BACK = _codes(BASES), _codes("AGTC")
_FORWARD[[ord("U"), ord("u")]] = _BACK[[ord("U"), ord("u")]] = BASES.index("T")  # a complement leaves U as it is, and it reads as T
_RESIDUES = np.frombuffer((AMINO + "X").encode(), np.uint8)


def six(text: str) -> list[tuple[int, bytes]]:
    """(frame, protein): frames 1 to 3, and -1 to -3 of the reverse complement; an incomplete last codon is left out."""
    raw = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128)
    out = []
    for sign, codes in ((1, _FORWARD[raw]), (-1, _BACK[raw][::-1])):
        at = codes[:-2] * 16 + codes[1:-1] * 4 + codes[2:]
        whole = _RESIDUES[np.minimum(at, 64)]
        out += [(sign * (f + 1), whole[f::3].tobytes()) for f in range(3)]
    return out


def six_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seq_id, seq) -> FRAMES, for mapInArrow; six nulls for a null sequence."""
    def rows(ids: list, frames: list, proteins: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(frames, pa.int32()), pa.array(proteins, pa.binary()).cast(pa.string())], names=["seq_id", "frame", "protein"])

    for batch in batches:
        ids, frames, proteins, held = [], [], [], 0
        for seq_id, text in zip(batch.column(0), batch.column(1)):
            value = text.as_py()
            for frame, protein in six(value) if value is not None else [(f, None) for f in (1, 2, 3, -1, -2, -3)]:
                ids.append(seq_id.as_py())
                frames.append(frame)
                proteins.append(protein)
                held += len(protein or b"")
            if held > BATCH:
                yield rows(ids, frames, proteins)
                ids, frames, proteins, held = [], [], [], 0
        if ids:
            yield rows(ids, frames, proteins)
