"""Quality rules as a short-circuit cascade.

Each rule reads one or two per-document features and says which documents it rejects. On a sample of about SAMPLE_ROWS
documents, drawn from the whole table, every feature's cost and every rule's verdicts are taken where the rules meet
them: on the documents that pass the base limits, whose base counts, words and lines are known by then. The order is
built greedily: next comes the rule with the most rejection per cost, its selectivity counted among the survivors of the
rules before it and its cost being that of the features which they haven't computed. Each rule runs only on the documents
that all earlier rules let through: a batch is cut down to the survivors, with the words and lines already found, before
the next feature is computed. The order changes what the run costs, never its verdict, since a document is kept if no
rule rejects it. The sample is profiled where it lies; the driver sees at most 2 ** rules verdict counts and one row of
costs a batch of it.

The features are numpy kernels over the bytes of many documents at once (see _text); a batch is worked on in pieces of
about a megabyte, so memory doesn't grow with the input.

Defined cases: a null text counts as empty: all counts are 0 and it is rejected by the base limit of ten words; a null
id is kept as it is; repeated rows are judged alike; other columns are ignored. A very long text is one piece of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panweave.llm import _text
from panweave.llm._spark import read, tidy

# The symbols that the base counts.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: The sample that orders the rules: about so many rows of the whole table, whatever their length.
SAMPLE_ROWS, SAMPLE_SEED = 1000, 17

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Features:
    """Lazily computed features of the documents of a chunk; values, words and lines are kept through take()."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, known: dict[str, np.ndarray] | None = None):
        self.data, self.bounds, self.known = data, bounds, known or {}
        self._words = self._word_keys = self._lines = None

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, keep: np.ndarray) -> Features:
        """The documents at `keep`; places of words and lines move down by the bytes left out before them."""
        if keep.all():
            return self
        sizes = np.diff(self.bounds)
        out = Features(self.data[np.repeat(keep, sizes)], np.concatenate(([0], np.cumsum(sizes[keep]))), {k: v[keep] for k, v in self.known.items()})
        gone = np.cumsum(np.where(keep, 0, sizes))  # up to and with each document
        if self._words is not None:
            w = self._words
            per_doc = w.per_doc
            own, down = np.repeat(keep, per_doc), np.repeat(gone[keep], per_doc[keep])
            out._words = _text.Words(w.start[own] - down, w.end[own] - down, np.concatenate(([0], np.cumsum(per_doc[keep]))))
            if self._word_keys is not None:
                out._word_keys = self._word_keys[own]
        if self._lines is not None:
            start, end, doc = self._lines
            own = keep[doc]
            down = gone[doc[own]]
            out._lines = start[own] - down, end[own] - down, (np.cumsum(keep) - 1)[doc[own]]
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = getattr(self, "_" + name)()
        return self.known[name]

    @property
    def words(self) -> _text.Words:
        if self._words is None:
            self._words = _text.words(self.data, self.bounds)
        return self._words

    @property
    def word_keys(self) -> np.ndarray:
        """A hash of every word."""
        if self._word_keys is None:
            self._word_keys = _text.span_hash(self.data, self.words.start, self.words.end)
        return self._word_keys

    def _per_doc(self, marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) == 2:  # a very long text is alone
            return np.array([np.count_nonzero(marks[bounds[0] : bounds[1]])])
        sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def _n_words(self) -> np.ndarray:
        return self.words.per_doc

    def _word_chars(self) -> np.ndarray:
        return self._per_doc(~_text._IS_SPACE[self.data] & ((self.data & 0xC0) != 0x80), self.bounds)

    def _n_symbols(self) -> np.ndarray:
        return self._per_doc(_SYMBOL[self.data], self.bounds)

    def _n_alpha_words(self) -> np.ndarray:
        w = self.words
        edges = np.empty(2 * len(w.start), np.int64)
        edges[::2], edges[1::2] = w.start, w.end
        some = np.logical_or.reduceat(np.append(_LETTER[self.data], False), edges)[::2] if len(edges) else np.zeros(0, bool)
        return self._per_doc(some, w.bounds)

    def _n_stutter_words(self) -> np.ndarray:
        """Words equal to the word before them in the same document."""
        w, key = self.words, self.word_keys
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        first = w.bounds[:-1]
        same[first[first < len(key)]] = False
        return self._per_doc(same, w.bounds)

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines that hold a word, and the document of each."""
        if self._lines is None:
            breaks = np.flatnonzero(self.data == 0x0A)
            start = np.concatenate((self.bounds[:-1], breaks + 1))
            end = np.concatenate((breaks, self.bounds[1:]))
            doc = np.concatenate((np.arange(len(self)), np.searchsorted(self.bounds, breaks, side="right") - 1))
            order = np.lexsort((start, doc))
            start, doc = start[order], doc[order]
            doc_end = np.concatenate((np.searchsorted(self.bounds, breaks, side="right") - 1, np.arange(len(self))))
            end = end[np.lexsort((end, doc_end))]
            some = np.searchsorted(self.words.start, end) > np.searchsorted(self.words.start, start)
            self._lines = start[some], end[some], doc[some]
        return self._lines

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[2], minlength=len(self))

    def _n_dup_lines(self) -> np.ndarray:
        start, end, doc = self.lines
        if not len(start):
            return np.zeros(len(self), np.int64)
        key = _text.span_hash(self.data, start, end)
        order = np.lexsort((key, doc))
        again = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        return np.bincount(doc[order][1:][again], minlength=len(self))

    def _n_repeat_words(self) -> np.ndarray:
        w = self.words
        key, at = _text.window_hash(self.word_keys, WINDOW), None
        if len(self) > 1:
            at = np.flatnonzero(_text.inside(w.bounds, WINDOW, len(w.start)))
            doc = np.searchsorted(w.bounds, at, side="right") - 1
            key = _text.mix(key[at] ^ _text.mix(doc.astype(np.uint64) + np.uint64(1)))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        if not len(twice):
            return np.zeros(len(self), np.int64)
        held = np.empty(len(key), bool)
        for a in range(0, len(key), 1 << 18):
            part = key[a : a + (1 << 18)]
            held[a : a + len(part)] = twice[np.minimum(np.searchsorted(twice, part), len(twice) - 1)] == part
        hit = np.flatnonzero(held)
        del key, held
        hit = hit if at is None else at[hit]
        cover = np.zeros(len(w.start) + 1, np.int32)
        cover[hit] += 1
        cover[hit + WINDOW] -= 1  # starts are distinct, so plain indexing adds once each
        return self._per_doc(np.cumsum(cover[:-1], dtype=np.int32) > 0, w.bounds)


@dataclass(frozen=True)
class Rule:
    name: str
    features: tuple[str, ...]
    rejects: Callable[[Features], np.ndarray]


#: Rules in percent, so that all arithmetic is whole.
RULES = (
    Rule("many_symbols", ("n_symbols", "n_words"), lambda f: 100 * f["n_symbols"] > 30 * f["n_words"]),
    Rule("word_length", ("word_chars", "n_words"), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 25 * f["n_words"])),
    Rule("few_letter_words", ("n_alpha_words", "n_words"), lambda f: 100 * f["n_alpha_words"] < 60 * f["n_words"]),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda f: (f["n_dup_lines"] >= 3) & (100 * f["n_dup_lines"] > 30 * f["n_lines"])),
    Rule("stutter", ("n_stutter_words", "n_words"), lambda f: 100 * f["n_stutter_words"] > 30 * f["n_words"]),
)
BASE = Rule("base", ("n_words", "n_repeat_words"), lambda f: (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"]))
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def profile(features: Features, rules: tuple[Rule, ...] = RULES) -> tuple[np.ndarray, dict[str, float]]:
    """Of the documents that pass the base limits: which rules reject each (bit i for rule i), and the CPU seconds of
    every feature that the base counts don't give."""
    for name in COLUMNS:
        features[name]
    alive = features.take(~BASE.rejects(features))
    cost: dict[str, float] = {}
    for name in sorted({f for r in rules for f in r.features} - set(COLUMNS)):
        began = time.process_time()
        alive[name]
        cost[name] = time.process_time() - began
    mask = np.zeros(len(alive), np.int64)
    for i, rule in enumerate(rules):
        mask |= rule.rejects(alive).astype(np.int64) << i
    return mask, cost


def plan_cascade(masks: dict[int, int], cost: dict[str, float], rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a document, share of the survivors rejected) in the order to run: masks holds how many sampled
    documents have which verdicts, cost the seconds of the features on all of them.

    A rule on known features alone still has to compare, which counts as a hundredth of the cheapest feature.
    """
    docs = max(1, sum(masks.values()))
    least = min((c for c in cost.values() if c > 0), default=1e-6) / 100
    left, known, alive, out = list(range(len(rules))), set(COLUMNS), dict(masks), []
    while left:
        n = sum(alive.values())

        def worth(i: int) -> tuple[float, float, float]:
            seconds = (least + sum(cost.get(f, 0.0) for f in rules[i].features if f not in known)) / docs
            share = sum(k for m, k in alive.items() if m >> i & 1) / n if n else 0.0
            return share / seconds, seconds, share

        best = max(left, key=lambda i: (worth(i)[0], -worth(i)[1], -i))
        out.append((rules[best], *worth(best)[1:]))
        left.remove(best)
        known |= set(rules[best].features)
        alive = {m: k for m, k in alive.items() if not m >> best & 1}
    return out


def measure(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> tuple[dict[int, int], dict[str, float]]:
    """The verdicts and costs of a sample of about `rows` documents of the whole table, for plan_cascade()."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _text.chunks(batch.column(0)):
                mask, cost = profile(Features(c.data, c.bounds), rules)
                value, n = np.unique(mask, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.tolist() + [None] * len(cost), pa.int64()), pa.array([None] * len(value) + list(cost), pa.string()), pa.array(n.tolist() + list(cost.values()), pa.float64())],
                                                 names=["mask", "feature", "n"])

    text = docs.select(F.col(text_col).cast("string").alias("text"))
    share = min(1.0, rows / max(1, text.count()))
    found = text.sample(fraction=share, seed=SAMPLE_SEED).mapInArrow(tidy(run), "mask long, feature string, n double").groupBy("mask", "feature").agg(F.sum("n").alias("n")).collect()  # 2 ** rules + features rows at most
    return {r["mask"]: int(r["n"]) for r in found if r["mask"] is not None}, {r["feature"]: r["n"] for r in found if r["feature"] is not None}


def run_cascade(features: Features, rules: list[Rule]) -> np.ndarray:
    """True for each document that no rule rejects; each rule sees the survivors of those before it."""
    kept = np.ones(len(features), bool)
    alive = np.arange(len(features))
    for rule in rules:
        if not len(alive):
            break
        out = rule.rejects(features)
        if out.any():
            kept[alive[out]] = False
            alive = alive[~out]
            features = features.take(~out)
    return kept


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: the base counts, base_failed and kept."""
    order = [r.name for r, _, _ in plan_cascade(*measure(docs, text_col, rules, sample_rows), rules)]
    by_name = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = [by_name[n] for n in order]
        for batch in batches:
            for c in _text.chunks(batch.column(1)):
                f = Features(c.data, c.bounds)
                base = [f[name].astype(np.int64) for name in COLUMNS]
                failed = BASE.rejects(f)
                kept = ~failed
                alive = np.flatnonzero(kept)
                if len(alive):
                    kept[alive] = run_cascade(f.take(kept), cascade)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.rows.start, len(c)), *map(pa.array, base), pa.array(failed), pa.array(kept)],
                                                 names=["doc_id", *COLUMNS, "base_failed", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, range(5) AS t(k) GROUP BY ALL),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha,
        len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutter
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
         OR 100 * n_alpha < 60 * n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * n_stutter > 30 * n_words) AS kept
FROM b
"""
