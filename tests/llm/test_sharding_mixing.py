import random
import re
import zlib
from collections import Counter

from panweave.llm import mixing, sharding
from tests.llm.conftest import edge_rows, make, words


def size(text):
    return len((text or "").encode()) + 8


def check_shards(rows, got, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    per = Counter(r["shard"] for r in got)
    assert not per or max(per.values()) - min(per.get(s, 0) for s in range(shards)) <= 1
    for s in per:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(per[s]))
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_shards(spark, edge, empty):
    check_shards(edge_rows(), sharding.shard(edge).collect(), 24)
    rng = random.Random(1)
    rows = [(rng.randrange(60), words(rng, 3), "en", "a") for _ in range(500)] + [(7, "same", "en", "a")] * 250  # a key with a third of the rows
    check_shards(rows, sharding.shard(make(spark, rows), shards=7).collect(), 7)
    assert sharding.shard(empty).collect() == []


def test_slack_moves_less():
    rng = random.Random(2)
    counts = Counter(rng.randrange(sharding.PLACES) for _ in range(20_000))
    home = {}
    for place, lo, hi, shard, _ in sharding.plan_ring(counts, 24, slack=1000.0):
        home[place, lo, hi] = shard

    def moved(slack):
        spots = {p: s for (p, _, _), s in home.items()}
        return sum(hi - lo for p, lo, hi, s, _ in sharding.plan_ring(counts, 24, slack) if spots[p] != s)

    assert moved(0.05) < moved(0.0) < 0.5 * 20_000
    held = Counter()
    for _, lo, hi, s, _ in sharding.plan_ring(counts, 24, 0.05):
        held[s] += hi - lo
    assert max(held.values()) <= 1.05 * (20_000 / 24 + 1) + 1


def walk(counts, shards, slack):
    """The ring as it is told, a document at a time: first every document to its own shard while it has room, place by
    place, then what is left over clockwise to the next shard with room."""
    nodes, total = sharding.ring(shards), sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    if slack:
        room = [int(r * (1 + slack)) + 1 for r in room]
    home, over = {}, []
    for place in sorted(counts):
        first = next((i for i, (p, _) in enumerate(nodes) if p >= place), 0)
        for k in range(counts[place]):
            if room[nodes[first][1]]:
                room[nodes[first][1]] -= 1
                home[place, k] = nodes[first][1]
            else:
                over.append((place, k, first))
    for place, k, at in over:
        while not room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        room[nodes[at][1]] -= 1
        home[place, k] = nodes[at][1]
    return home


def planned(counts, shards, slack):
    return {(p, k): s for p, lo, hi, s, _ in sharding.plan_ring(counts, shards, slack) for k in range(lo, hi)}


def test_plan_is_the_ring_walked_a_document_at_a_time():
    rng = random.Random(3)
    counts = Counter(rng.randrange(sharding.PLACES) for _ in range(1500))
    counts[77] += 750  # one place holds a third
    for shards, slack in ((5, 0.0), (7, 0.1), (3, 2.0)):
        assert planned(counts, shards, slack) == walk(counts, shards, slack)


def test_one_shard_more_moves_few_rows():
    """The even share of a new shard is 1 / 25; even counts (slack 0) make overflow move besides."""
    rng = random.Random(4)
    counts = Counter(rng.randrange(sharding.PLACES) for _ in range(20_000))

    def moved(slack):
        before, after = planned(counts, 24, slack), planned(counts, 25, slack)
        return sum(before[k] != after[k] for k in before) / 20_000

    assert moved(0.25) <= 1.5 / 25 and moved(0.0) <= 2.5 / 25
    assert moved(1000.0) <= 1.5 / 25


def test_equal_rows_are_dealt_over_the_cells(spark):
    """A row that repeats lies in SALTS cells of its place, and in TIES parts of a mix's cell."""
    rows = [(7, "the same words", "en", "a")] * 6400 + [(i, "x y", "en", "b") for i in range(10)]
    cells = spark.range(6400).selectExpr(f"pmod(xxhash64(id), {sharding.SALTS}) AS salt", f"pmod(id, {mixing.TIES}) AS tie")
    assert cells.groupBy("salt").count().agg({"count": "max"}).first()[0] < 160 and cells.groupBy("tie").count().agg({"count": "max"}).first()[0] <= 6400 / mixing.TIES
    check_shards(rows, sharding.shard(make(spark, rows), shards=7).collect(), 7)
    got = mixing.mix(make(spark, rows)).collect()
    check_mix(rows, got)
    assert Counter(r["copies"] for r in got if r["doc_id"] == 7).most_common(1)[0][1] >= 3000


def targets(sizes, weights=(5, 2, 1), total=1.5, cap=2):
    """The sharing as it is told: give by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = total * sum(sizes.values()), set(order), {}
    while free:
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) >= cap * sizes[s]]
        if not over:
            out |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            free.discard(s)
            left -= out[s]
    return out


def check_mix(rows, got):
    n = [len([w for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]) for _, t, *_ in rows]
    sizes = Counter()
    for (_, _, _, s), k in zip(rows, n, strict=True):
        sizes[s] += k
    want = targets(dict(sizes))
    assert Counter((r["doc_id"], r["source"], r["size"], r["source_size"]) for r in got) == Counter((d, s, k, sizes[s]) for (d, _, _, s), k in zip(rows, n, strict=True))
    taken, most = Counter(), Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * most[s] + 1, (s, taken[s], want[s])


def test_mix(spark, edge, empty):
    check_mix(edge_rows(), mixing.mix(edge).collect())
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(0, 60)), "en", rng.choice(["a", "b", "c", "d", None, "a", "a"])) for i in range(900)]
    got = mixing.mix(make(spark, rows)).collect()
    check_mix(rows, got)
    assert sorted(got, key=str) == sorted(mixing.mix(make(spark, rows)).collect(), key=str)
    assert mixing.mix(empty).collect() == []


def test_emit(spark, edge):
    plan = Counter()
    for r in mixing.mix(edge).collect():
        plan[r["doc_id"]] += r["copies"]
    assert sum(r["copies"] for r in mixing.mix(make(spark, edge_rows() * 3)).collect()) == mixing.emit(make(spark, edge_rows() * 3)).count()
    out = mixing.emit(edge)
    assert out.columns == edge.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +plan
