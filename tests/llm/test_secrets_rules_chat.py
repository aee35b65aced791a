import hashlib
import random
import re
from collections import Counter

from panweave.llm import chat, rules, secrets
from tests.llm.conftest import edge_rows, make
from tests.llm.test_minhash import thue_morse

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [("assign", m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end(), 1, m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end(), 2, m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], x[3]))


def test_secrets(spark, edge, empty):
    got = secrets.scan(edge).collect()
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == Counter(
        (d, *[sum(b[0] == k for b in base(t or "")) for k in ("assign", "access", "hex")], hashlib.sha256(",".join(f"{b[0]}:{b[1]}:{b[2]}" for b in base(t or "")).encode()).hexdigest()) for d, t, *_ in edge_rows())
    for r in got:
        text = next(t or "" for d, t, *_ in edge_rows() if d == r["doc_id"])
        assert {f"{b[0]}:{b[1]}:{b[2]}" for b in base(text)} <= set(r["spans"].split(",")) | {""}
    assert secrets.scan(empty).collect() == []


def test_ownership(spark):
    shared, own, token = "deadbeef" * 5, "0123456789abcdef" * 3, "Zx9-Kq8_Lw7-Mn6_Pr5-Ts4_Uv3"
    rows = [(i, f"é secret={shared} x", "en", f"s{i}") for i in range(6)] + [(10, f"api_key: {own}", "en", "s1"), (11, f"plain {token} text {shared}", "en", "s2"), (12, "xxxxxxxxxxxx password=aaaaaaaa", "en", "s3")]
    got = {r["doc_id"]: r for r in secrets.scan(make(spark, rows)).collect()}
    assert got[0]["n_live"] == 0 and got[0]["n_example"] == 2
    assert got[10]["n_live"] == 2 and got[10]["n_example"] == 0
    assert got[11]["spans"].split(",")[0] == f"owned:6:{6 + len(token)}"
    assert got[12]["n_live"] == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(make(spark, rows)).collect()}
    assert clean[0] == rows[0][1] and clean[12] == rows[8][1]
    assert clean[10] == "[secret]" and clean[11] == f"plain [secret] text {shared}"


def test_repositories_decide_too(spark):
    """One owner: a value in many different texts is an example; in many exact copies of one text it isn't."""
    pasted, own = "0011223344556677" * 2, "8899aabbccddeeff" * 2
    rows = [(i, f"note {i} secret={pasted}", "en", "hot") for i in range(secrets.EXAMPLE_REPOS)] + [(1000 + i, f"secret={own}", "en", "hot") for i in range(2 * secrets.EXAMPLE_REPOS)]
    got = {r["doc_id"]: r for r in secrets.scan(make(spark, rows)).collect()}
    assert (got[0]["n_live"], got[0]["owners"], got[0]["repositories"]) == (0, "1,1", f"{secrets.EXAMPLE_REPOS},{secrets.EXAMPLE_REPOS}")
    assert (got[1000]["n_live"], got[1000]["owners"], got[1000]["repositories"]) == (2, "1,1", "1,1")


def test_many_matches_in_one_text(spark):
    """50,000 values in one text: spans and redaction in time that grows with the text, not with its square."""
    import time

    text = "é ".join(f"{i:032x} key{i:05d}" for i in range(50_000))
    doc = make(spark, [(1, text, "en", "a"), (2, "clean", "en", "a")])
    began = time.monotonic()
    r = {r["doc_id"]: r for r in secrets.scan(doc).collect()}[1]
    assert time.monotonic() - began < 20
    assert r["n_hex"] == 50_000 and r["base_sha256"] == hashlib.sha256(",".join(f"{b[0]}:{b[1]}:{b[2]}" for b in base(text)).encode()).hexdigest()
    began = time.monotonic()
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(doc).collect()}
    assert time.monotonic() - began < 20
    varied = [i for i in range(50_000) if len(set(f"{i:032x}")) >= secrets.MIN_DISTINCT]
    want = re.sub(r"[0-9a-f]{32}", lambda m: "[secret]" if len(set(m[0])) >= secrets.MIN_DISTINCT else m[0], text)
    assert varied and clean[1] == want and clean[2] == "clean"


def test_overlapping_live_spans_get_one_mark(spark):
    token, key = "Ab3-" + "Zx9_Kq8" * 4, "AKIA" + "QWERTY123456ZXCV"
    rows = [(1, f"é password={key} and {token}é{key}.", "en", "a")]
    assert secrets.redact(make(spark, rows)).first()["text"] == "é [secret] and [secret]é[secret]."


def test_redact_keeps_everything_else(edge, empty):
    out = secrets.redact(edge)
    assert out.columns == edge.columns
    before, after = Counter(map(tuple, edge.collect())), Counter(map(tuple, out.collect()))
    assert sum((before - after).values()) == 2  # documents 10 and 11
    assert secrets.redact(empty).collect() == []


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(win)
    cover = {i + k for i, x in enumerate(win) if often[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_rules(spark, edge, empty):
    rng = random.Random(5)
    more = [(100 + i, "".join(rng.choice(["ab ", "é", "\n", "c d ", "##", "\t", "x y z w v ", "ü\x85 "]) for _ in range(rng.randrange(0, 90))), "en", "a") for i in range(60)]
    for rows in (edge_rows(), more):
        for r in rules.judge(make(spark, rows)).collect():
            text = next(t or "" for d, t, *_ in rows if d == r["doc_id"])
            assert tuple(r)[1:6] == counts(text), text
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert rules.judge(empty).collect() == []


def test_regular_lines_are_told_apart(spark):
    one, two = thue_morse()
    rows = [(1, f"{one}\n{two}", "en", "a"), (2, f"{one}\n{two}\n{one}", "en", "a"), (3, f"a b c {one} d\na b c {two} d", "en", "a")]
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in rules.judge(make(spark, rows)).collect()}
    assert got == {1: (0, 0), 2: (1, 0), 3: (0, 0)}


def test_cascade_order_never_changes_the_verdict():
    import pyarrow as pa

    from panweave.llm import _text

    texts = [t for _, t, *_ in edge_rows()] + ["# # # | | |" * 9, "a b c d e f g h i j k l", "x " * 50]
    for c in _text.chunks(pa.array(texts, pa.large_string())):
        verdicts = {tuple(rules.run_cascade(rules.Features(c.data, c.bounds), list(order))) for order in (rules.RULES, rules.RULES[::-1])}
        assert len(verdicts) == 1


def test_survivors_carry_words_and_lines():
    """take() gives what a fresh look at the same documents finds."""
    import numpy as np
    import pyarrow as pa

    from panweave.llm import _text

    rng = random.Random(12)
    texts = ["".join(rng.choice(["ab ", "é", "\n", "c d ", "##", "x y x y "]) for _ in range(rng.randrange(0, 40))) for _ in range(40)]
    names = [*rules.COLUMNS, "n_alpha_words", "n_stutter_words", "n_lines"]
    fresh = lambda some: next(rules.Features(c.data, c.bounds) for c in _text.chunks(pa.array(some, pa.large_string()), 1 << 30))
    for _ in range(20):
        keep = np.array([rng.random() < 0.6 for _ in texts])
        f = fresh(texts)
        f.words, f.lines, f.word_keys  # noqa: B018  found before the cut
        cut, plain = f.take(keep), fresh([t for t, k in zip(texts, keep, strict=True) if k])
        for name in names:
            assert cut[name].tolist() == plain[name].tolist(), name
        assert cut.words.start.tolist() == plain.words.start.tolist() and [x.tolist() for x in cut.lines] == [x.tolist() for x in plain.lines]


def test_cascade_is_the_greedy_order():
    """Rejection per cost among the survivors, against all rules tried at each step."""
    rng = random.Random(13)
    known = set(rules.COLUMNS)
    for _ in range(100):
        masks = {rng.randrange(32): rng.randrange(1, 50) for _ in range(8)}
        cost = {f: rng.random() for f in ("n_alpha_words", "n_lines", "n_stutter_words")}
        plan = rules.plan_cascade(masks, cost)
        assert sorted(r.name for r, *_ in plan) == sorted(r.name for r in rules.RULES)
        alive, seen = dict(masks), set(known)
        for at, (rule, seconds, share) in enumerate(plan):
            best = 0.0
            for other, *_ in plan[at:]:
                i = rules.RULES.index(other)
                paid = (min(cost.values()) / 100 + sum(cost[f] for f in other.features if f not in seen)) / sum(masks.values())
                out = sum(n for m, n in alive.items() if m >> i & 1) / max(1, sum(alive.values()))
                best = max(best, out / paid)
            assert abs(share / seconds - best) < 1e-9
            alive = {m: n for m, n in alive.items() if not m >> rules.RULES.index(rule) & 1}
            seen |= set(rule.features)


def test_the_sample_is_of_the_whole_table(spark):
    """Long texts and late rows take part; masks count the verdicts of those that pass the base limits."""
    rows = [(i, f"a{i} b c d e f g h i j k l {i}", "en", "a") for i in range(300)] + [(999, " ".join(f"w{i} ##" for i in range(30_000)), "en", "a")]
    masks, cost = rules.measure(make(spark, rows), rows=10_000)
    assert sum(masks.values()) == 301 and sum(n for m, n in masks.items() if m & 1) == 1 and set(cost) == {"n_alpha_words", "n_lines", "n_stutter_words"}


TURNS = "conv_id long, turn long, role string, text string, w int, k string, n int, block string, system int"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "b", 3) for r in rows], TURNS)


def digest(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "<\\|", "<|", "\n", "é word ", "x" * 200, "<\\\\|", ""]
    rows = []
    for c in [*range(25), None]:
        for t in range(rng.randrange(1, 40)):
            role = "system" if t == 0 and rng.random() < 0.6 else rng.choice(["user", "assistant", "user", "tool\nx", None])
            rows.append((c, t if rng.random() < 0.95 else None, role, rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))])))
    rows += [(3, 5, "assistant", "again")] * 2 + [(50, 300 * i, "assistant", f"far {i} " + "y" * 900) for i in range(8)]
    frame = talk(spark, rows)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.windows(frame)).collect()}
    assert got == digest(rows)


def test_chat_windows(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "z" * 400) for i in range(1, 30)]
    out = sorted(chat.windows(talk(spark, rows)).collect(), key=lambda r: r["window"])
    assert len(out) > 3
    for r in out:
        assert r["text"].startswith("<|im_start|>system\nbe brief<|im_end|>\n")
        assert r["tokens"] <= 6 + 4 + chat.STRIDE + chat.HISTORY + 2 * 120
        for a, b in r["loss"]:
            assert r["text"][:a].endswith("<|im_start|>assistant\n") and r["text"][b:].startswith("<|im_end|>")
    assert sum(len(r["loss"]) for r in out) == sum(role == "assistant" for _, _, role, _ in rows)
    assert all(r["n_context"] > 1 for r in out[1:])


def test_chat_empty(spark):
    assert chat.read_back(chat.windows(talk(spark, []))).collect() == []
