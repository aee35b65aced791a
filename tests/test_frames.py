"""Six reading frames by table lookup against the Column expression."""

from pyspark.sql import functions as F

from panweave.functions import frames
from panweave.functions import sequences as S


def test_frames_equal_the_expression(spark):
    texts = ["", "A", "ACG", "acguUTNNN ATGaa", "ATGGCCTAAé\U0001f9ecTTTCAT", "UUUUUUUUU", "x" * 10, "ATG\nCCC-T", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    plain = rows.select("seq_id", F.explode(S.six_frames(F.col("seq"))).alias("f")).select("seq_id", "f.frame", "f.protein")
    found = rows.mapInArrow(frames.six_frames, frames.FRAMES)
    assert found.count() == 6 * len(texts) and sorted(map(tuple, found.filter("seq_id < 8").collect())) == sorted(map(tuple, plain.filter("seq_id < 8").collect()))
    assert {r["protein"] for r in found.filter("seq_id = 8").collect()} == {None}


def test_batches_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(["ACG" * 100_000] * 40)], names=["seq_id", "seq"])
    got = list(frames.six_frames(iter([batch])))
    assert sum(b.num_rows for b in got) == 240 and max(b.nbytes for b in got) < 2 * frames.BATCH
