"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are found by pattern: `assign` (a named value), `access` (an access key id) and `hex` (a long hexadecimal
run). A fourth, `token`, is any long run of letters, digits, _ and - that mixes digits with both cases: alone it says
little, so it counts only by the method's verdict. Every candidate's value is hashed, and the hashes are counted over
the whole corpus by distinct owners and distinct repositories. A value that EXAMPLE_OWNERS or more owners or
EXAMPLE_REPOS or more repositories hold is a widely copied example; one that few hold, and that isn't a placeholder of a
few characters, looks live. By default a source is the owner and a text the repository, so exact copies of a document
count as one repository. Live tokens outside the base spans are added to a document's spans as kind `owned`; base spans
always stay.

The text is scanned once, in place: the scan keeps the matches and the lengths of what lies between them. Matches then
become rows, and running sums over a document's rows give starts and ends (in code points and in bytes), a running
maximum tells which tokens lie apart from base spans. All of it is linear in the matches of a text but for sorting. Only
candidates are shuffled, and only documents with candidates are joined. Counting is by partial aggregates over (value,
owner) and (value, repository), so a value in a third of all documents is no single task's work.

Defined cases: null texts count as empty; a null owner is one owner of its own; repeated rows are rows of their own (but
one repository); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panweave.llm._spark import Tables, read, source_key

# The base patterns. (?i) folds ASCII letters only. The runs of the last two can be matched with their
# least length at once, since a run starts at its leftmost match either way.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9_-]{24,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}
BASE = ("assign", "access", "hex")
ORDER = {"assign": 0, "access": 1, "hex": 2, "token": 3}
NAMES = ("assign", "access", "hex", "owned")
MIN_ASSIGN = 8
EXAMPLE_OWNERS = 5
EXAMPLE_REPOS = 100
MIN_DISTINCT = 5


def _hits(text: Column) -> dict[str, Column]:
    """Whether a text has a match of each kind. What a match needs is asked first where that is cheaper: an assignment
    has a : or =, an access key its first letters, and a hexadecimal run is a run of the token's characters."""
    token = text.rlike(TOKEN)
    return {"assign": (text.contains(":") | text.contains("=")) & text.rlike(ASSIGN), "access": text.contains("AKIA") & text.rlike(ACCESS), "hex": token & text.rlike(HEX), "token": token}


def _scanned(text: Column) -> list[Column]:
    """Matches of each kind and the lengths (code points, bytes) of the text between them; null where there is none."""
    out = []
    for kind, hit in _hits(text).items():
        gaps = F.transform(F.split(text, KINDS[kind], -1), lambda x: F.struct(F.length(x).alias("c"), F.octet_length(x).alias("b")))
        out += [F.when(hit, F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(0))).alias(f"m_{kind}"), F.when(hit, gaps).alias(f"p_{kind}")]
    return out


def _matches(kind: str) -> Column:
    gap = lambda i: F.get(f"p_{kind}", i)
    rows = F.transform(f"m_{kind}", lambda m, i: F.struct(F.lit(ORDER[kind]).alias("ord"), i.alias("i"), gap(i)["c"].alias("gap"), gap(i)["b"].alias("gap_b"), m.alias("match")))
    return F.coalesce(rows, F.array().cast("array<struct<ord:int,i:int,gap:int,gap_b:int,match:string>>"))


def candidates(tables: Tables, rows: DataFrame, text: Column, owner: Column, repo: Column, keep: list[str], example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> tuple[DataFrame, DataFrame]:
    """The rows with a number (`keep` and _row), and every candidate: the base spans and the tokens outside them.

    Candidates: _row, start, end (code points), start_b, end_b (bytes), ord (place in NAMES), owners, repos, live.
    """
    body = F.coalesce(text, F.lit(""))
    found = tables.save(rows.select(*keep, owner.alias("_owner"), repo.alias("_repo"), F.monotonically_increasing_id().alias("_row"), *_scanned(body)))
    some = F.lit(False)
    for kind in KINDS:
        some = some | F.col(f"m_{kind}").isNotNull()
    each = found.filter(some).select("_row", "_owner", "_repo", F.explode(F.concat(*[_matches(k) for k in KINDS])).alias("m")).select("_row", "_owner", "_repo", "m.*")
    along = W.partitionBy("_row", "ord").orderBy("i")
    upto, before = along.rowsBetween(W.unboundedPreceding, 0), along.rowsBetween(W.unboundedPreceding, -1)
    size, size_b = F.length("match"), F.octet_length("match")
    each = each.withColumns({"start": F.sum("gap").over(upto) + F.coalesce(F.sum(size).over(before), F.lit(0)), "start_b": F.sum("gap_b").over(upto) + F.coalesce(F.sum(size_b).over(before), F.lit(0))})
    value = F.when(F.col("ord") == ORDER["assign"], F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    each = each.select("_row", "_owner", "_repo", "ord", F.col("start").cast("int").alias("start"), (F.col("start") + size).cast("int").alias("end"), F.col("start_b").cast("int").alias("start_b"), (F.col("start_b") + size_b).cast("int").alias("end_b"), value.alias("value"))
    base, v = F.col("ord") != ORDER["token"], F.col("value")
    mixed = v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    each = each.filter(F.when(F.col("ord") == ORDER["assign"], F.length(v) >= MIN_ASSIGN).when(base, F.lit(True)).otherwise(mixed))
    # a token lies apart if no base span from at or before its start reaches it and none begins inside it
    reach = F.max(F.when(base, F.col("end"))).over(W.partitionBy("_row").orderBy("start").rangeBetween(W.unboundedPreceding, 0))
    following = F.min(F.when(base, F.col("start"))).over(W.partitionBy("_row").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, -1))
    apart = (F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end"))
    each = each.withColumns({"_reach": reach, "_next": following}).filter(base | apart)
    spans = tables.save(each.select("_row", "_owner", "_repo", "ord", "start", "end", "start_b", "end_b", F.sha2("value", 256).alias("v"), (F.size(F.array_distinct(F.split("value", ""))) >= MIN_DISTINCT).alias("varied")))
    held = spans.groupBy("v").agg(F.count_distinct("_owner").alias("owners"), F.count_distinct("_repo").alias("repos"))
    live = (F.col("owners") < example_owners) & (F.col("repos") < example_repos) & F.col("varied")
    return found.select(*keep, "_row"), spans.join(held, "v").select("_row", "start", "end", "start_b", "end_b", "ord", "owners", "repos", live.alias("live"))


def _text_of(docs: DataFrame, text_col: str, owner_col: str, repo_col: str | None) -> tuple[Column, Column, Column]:
    """Text, owner and repository of a row: without a column for it, the repository is the text itself."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return text, source_key(owner_col), F.sha2(text, 256) if repo_col is None else source_key(repo_col)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per document: doc_id, counts of base matches, base_sha256, spans, the owners and repositories of each of
    the spans' values, n_live, n_example."""
    tables = Tables(docs.sparkSession, "secrets")
    text, owner, repo = _text_of(docs, text_col, owner_col, repo_col)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), owner.alias("_o"), repo.alias("_r"))
    found, judged = candidates(tables, rows, F.col("_text"), F.col("_o"), F.col("_r"), ["_id"], example_owners, example_repos)
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("ord") + 1)
    word = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    base = F.col("ord") != ORDER["token"]
    listed = lambda which, item: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(which, F.struct("start", "ord", item.alias("x"))))), lambda s: s["x"]), ",")
    count = lambda which: F.count(F.when(which, 1))
    shown = base | F.col("live")
    per_row = judged.groupBy("_row").agg(
        *[count(F.col("ord") == ORDER[k]).alias(f"n_{k}") for k in BASE], listed(base, word).alias("base"), listed(shown, word).alias("spans"), listed(shown, F.col("owners").cast("string")).alias("owners"),
        listed(shown, F.col("repos").cast("string")).alias("repositories"), count(F.col("live")).alias("n_live"), count(base & ~F.col("live")).alias("n_example"))
    zero, none = F.lit(0).cast("long"), F.lit("")
    return found.join(per_row, "_row", "left").select(
        F.col("_id").alias(id_col), *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in BASE], F.sha2(F.coalesce("base", none), 256).alias("base_sha256"),
        *[F.coalesce(c, none).alias(c) for c in ("spans", "owners", "repositories")], *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example")])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, mark: str = "[secret]", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """The rows of docs with every live-looking span of the text replaced by `mark`; other columns stay.

    Documents without a candidate pass straight through; only those with one are written, judged and rebuilt. A span
    that overlaps one before it gets no mark of its own.
    """
    tables = Tables(docs.sparkSession, "redact")
    columns = docs.columns
    text, owner, repo = _text_of(docs, text_col, owner_col, repo_col)
    candidate = F.lit(False)
    for hit in _hits(text).values():
        candidate = candidate | hit
    # the row travels as one struct, so that its names can't clash with the scan's
    boxed = docs.filter(candidate).select(F.struct(*[F.col(c) for c in columns]).alias("_doc"), text.alias("_text"), owner.alias("_o"), repo.alias("_r"))
    found, judged = candidates(tables, boxed, F.col("_text"), F.col("_o"), F.col("_r"), ["_doc"], example_owners, example_repos)
    reach = F.coalesce(F.max("end_b").over(W.partitionBy("_row").orderBy("start_b", "end_b", "ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = judged.filter("live").withColumn("reach", reach).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.when(F.col("start_b") >= F.col("reach"), F.struct("reach", "start_b")))).alias("_cuts"), F.max("end_b").alias("_last"))

    def rebuilt(data: Column) -> Column:
        """What lies between the cuts, with a mark at each; data: the text's bytes, in which a piece is found at once."""
        kept = F.transform("_cuts", lambda c: F.concat(F.substring(data, c["reach"] + 1, c["start_b"] - c["reach"]).cast("string"), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), F.substring(data, F.col("_last") + 1, F.octet_length(data)).cast("string"))

    # through a lambda's variable, so that the bytes are made once a text and not once a cut
    bytes_of = F.col("_doc")[text_col].cast("string").cast("binary")
    clean = F.when(F.col("_last").isNotNull(), F.get(F.transform(F.array(bytes_of), rebuilt), F.lit(0))).otherwise(F.col("_doc")[text_col].cast("string"))
    done = found.join(cuts, "_row", "left").withColumn("_clean", clean).select(*[F.col("_clean").alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in columns])
    return docs.filter(~candidate).select(*columns).unionByName(done)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _oracle_spans(kind: str, pattern: str, value: str, keep: str, order: int) -> str:
    return f"""
  SELECT doc_id, source, repo, {order} AS o, '{'owned' if kind == 'token' else kind}' AS kind, m[i] AS m, {value} AS v,
         (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT doc_id, source, repo, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, source, repo, regexp_extract_all(t, {pattern}) AS m, string_split_regex(t, {pattern}) AS p FROM d WHERE regexp_matches(t, {pattern})))
  WHERE {keep}"""


def _letters(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# RE2 folds some non-ASCII letters under (?i), so the names are spelt in both cases.
_NAMES = "|".join(map(_letters, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN_RE2 = f"""('({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')"""
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS repo FROM documents),
b AS ({_oracle_spans("assign", _ASSIGN_RE2, f"regexp_extract(m[i], {_ASSIGN_RE2}, 2)", "length(v) >= 8", 0)}
  UNION ALL {_oracle_spans("access", f"'{ACCESS}'", "m[i]", "true", 1)}
  UNION ALL {_oracle_spans("hex", f"'{HEX}'", "m[i]", "true", 2)}),
t AS ({_oracle_spans("token", f"'{TOKEN}'", "m[i]", "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')", 3)}),
c AS (SELECT * FROM b UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = t.doc_id AND b.s < t.s + length(t.m) AND t.s < b.s + length(b.m))),
h AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT repo) AS repos FROM c GROUP BY v),
j AS (SELECT c.*, owners, repos, kind || ':' || s || ':' || s + length(m) AS w, owners < {EXAMPLE_OWNERS} AND repos < {EXAMPLE_REPOS} AND len(list_distinct(string_split(v, ''))) >= {MIN_DISTINCT} AS live FROM c JOIN h USING (v)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS x,
        string_agg(w, ',' ORDER BY s, o) FILTER (kind <> 'owned') AS base, string_agg(w, ',' ORDER BY s, o) FILTER (kind <> 'owned' OR live) AS spans,
        string_agg(owners, ',' ORDER BY s, o) FILTER (kind <> 'owned' OR live) AS owners, string_agg(repos, ',' ORDER BY s, o) FILTER (kind <> 'owned' OR live) AS repositories,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live AND kind <> 'owned') AS n_example FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(owners, '') AS owners, coalesce(repositories, '') AS repositories, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (doc_id)
"""
