"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of places. Every shard stands at `vnodes` of them, every document at the place that its id
hashes to, and it belongs to the next shard clockwise. Shards have a capacity; what a full shard can't hold goes on
clockwise to the next shard with room. Only overflow moves, so a ring that is nearly even moves little.

Law `rows`: with slack 0 the capacities add up to the number of documents and differ by one at most, so counts do too.
With slack above 0 a shard holds at most (1 + slack) times its even share and fewer documents move.

Only the counts of the ring's places (a fixed number, whatever the input) reach the driver, which walks the ring once
and returns stretches (place, from, to) -> shard. Documents find their stretch by their rank within the place; places
are cut into cells by the number of the row, so no task ranks a whole place, also where one id or one row repeats in a
third of the table. Texts never enter a shuffle.

Defined cases: null text has 0 bytes and checksum 0; a null id hashes like an empty key; repeated rows are rows of their
own; an empty table gives an empty result; other columns are ignored. Equal texts (groups) aren't kept together, since
one group may hold a third of all rows.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.llm._spark import Tables, read

PLACES = 1 << 14
VNODES = 128
SALTS = 64


def ring(shards: int, vnodes: int = VNODES, places: int = PLACES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, sorted; a place taken twice keeps both, in order of a second hash."""
    def spot(shard: int, v: int) -> tuple[int, int]:
        h = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=16).digest()
        return int.from_bytes(h[:8], "little") % places, int.from_bytes(h[8:], "little")

    nodes = sorted((*spot(s, v), s) for s in range(shards) for v in range(vnodes))
    return [(place, s) for place, _, s in nodes]


def plan_ring(counts: dict[int, int], shards: int, slack: float = 0.0, vnodes: int = VNODES, places: int = PLACES) -> list[tuple[int, int, int, int, int]]:
    """(place, from, to, shard, slot of `from`): which ranks of each place go where."""
    nodes = ring(shards, vnodes, places)
    spots = [p for p, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    if slack:
        room = [int(r * (1 + slack)) + 1 for r in room]
    used = [0] * shards
    stretches, over = [], []

    def put(place: int, begin: int, end: int, shard: int) -> int:
        take = min(end - begin, room[shard])
        if take:
            stretches.append((place, begin, begin + take, shard, used[shard]))
            used[shard] += take
            room[shard] -= take
        return begin + take

    for place in sorted(counts):
        at = bisect.bisect_left(spots, place) % len(nodes)
        rest = put(place, 0, counts[place], nodes[at][1])
        if rest < counts[place]:
            over.append((place, rest, counts[place], at))
    # What its own shard could not hold walks on clockwise; `onward` skips nodes whose shard is full by now.
    onward = list(range(len(nodes)))

    def next_open(i: int) -> int:
        path = []
        while room[nodes[i][1]] == 0:
            path.append(i)
            nxt = onward[i] if onward[i] != i else (i + 1) % len(nodes)
            i = nxt
        for p in path:
            onward[p] = i
        return i

    for place, begin, end, at in over:
        while begin < end:
            at = next_open(at)
            begin = put(place, begin, end, nodes[at][1])
    return stretches


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.0, vnodes: int = VNODES, places: int = PLACES) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    tables = Tables(spark, "shard")
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    narrow = tables.save(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(key), F.lit(places)).cast("int").alias("place"), F.monotonically_increasing_id().alias("row"),
    )).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    cells = narrow.groupBy("place", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("place").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["place"]: r["n"] for r in cells.groupBy("place").agg(F.sum("n").alias("n")).toLocalIterator()}  # `places` rows at most
    stretches = plan_ring(counts, shards, slack, vnodes, places)
    plan = spark.createDataFrame(stretches, "place int, lo long, hi long, shard int, base long")
    within = F.row_number().over(W.partitionBy("place", "salt").orderBy("row")) - 1
    ranked = narrow.withColumn("within", within).join(starts, ["place", "salt"]).withColumn("rank", F.col("begin") + F.col("within"))
    placed = ranked.join(plan, (ranked["place"] == plan["place"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("base") + F.col("rank") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
