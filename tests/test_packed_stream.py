"""Packed files leave in bounded batches, whatever their size."""

import gzip

import pyarrow as pa

from panweave.sources import text


def test_records_of_a_large_file_leave_in_batches():
    body = b"".join(b">r%d\n%s\n" % (i, b"ACGT" * 2_500) for i in range(3_000))  # 30 MB
    files = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([gzip.compress(body, 1), b"", b">x\nA\nC"], pa.binary())], names=["file", "content"])
    got = list(text._packed_records(iter([files])))
    assert max(b.nbytes for b in got) < 2 * text.RECORDS and len(got) > 5
    rows = pa.Table.from_batches(got).to_pydict()
    assert rows["pos"] == [*range(3_000), 0] and rows["header"] == [*(f"r{i}" for i in range(3_000)), "x"] and set(rows["file"]) == {"a", "c"}
    assert rows["seq"][0].strip() == "ACGT" * 2_500 and rows["seq"][-1] == "A\nC"
