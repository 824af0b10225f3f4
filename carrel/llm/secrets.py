"""Secret scans through a trigram inverted index (DataFrame functions only).

For each rule a Boolean trigram query is derived from its regex: ALL of some queries, ANY of some, one trigram, or nothing known. The index holds, for every trigram
that a query names, the documents with it (lower-cased); postings are intersected and united natively by counting, per document, which trigrams it has.
Only the candidates of a rule are verified with its regex. A rule whose query is empty (no mandatory trigram) scans every document.

Matches are leftmost and non-overlapping per kind; spans are [start, end) in code points, so positions are sums of the lengths of the pieces between matches.
The base kinds ``assign``, ``access`` and ``hex`` come first; the others are public token formats.

Postings are rows (trigram, doc_id); a frequent trigram is many rows, never one list, and sums per document are combined before the shuffle.

Nulls: a null text is empty; a document with a null doc_id is looked up by its text; documents with one doc_id share postings, which only adds candidates. An empty table gives no rows.
Extra columns are carried along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.llm.common import spread, table, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: code points of the match (or of its group) below which it is dropped."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.regex


#: The base kinds, in the order of their spans, then public formats of keys and tokens.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)

# --- trigram queries ---------------------------------------------------------------------------------------------------------------------------
#: A query is True (nothing known), a trigram, ("all", queries) or ("any", queries).
Query = object
#: Sets of alternative strings above this size are given up.
MOST = 32


def both(kind: str, parts: list) -> Query:
    """ALL or ANY of the parts, simplified."""
    if kind == "any" and any(p is True for p in parts):
        return True
    flat = []
    for p in parts:
        for q in p[1] if isinstance(p, tuple) and p[0] == kind else [p]:
            if q is not True and q not in flat:
                flat.append(q)
    return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def of_strings(strings: set[str]) -> Query:
    """Some one of the strings occurs; a string that holds another one adds nothing."""
    strings = {s for s in strings if not any(t != s and t in s for t in strings)}
    return both("any", [both("all", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)]) if strings else True


def cross(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MOST else None


def alternatives(node) -> set[str] | None:
    """All strings that a parsed node matches, lower-cased, if they are few."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        out: set[str] = set()
        for o, a in arg:
            if o is C.LITERAL:
                out.add(chr(a).lower())
            elif o is C.RANGE and a[1] - a[0] < MOST:
                out |= {chr(x).lower() for x in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= MOST // 4 else None
    if op is C.SUBPATTERN:
        return sequence_strings(arg[-1])
    if op is C.BRANCH:
        parts = [sequence_strings(x) for x in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op is C.MAX_REPEAT and arg[1] != C.MAXREPEAT and arg[1] <= 4 and (one := sequence_strings(arg[2])) is not None:
        out, power = set(), {""}
        for n in range(arg[1] + 1):
            if n >= arg[0]:
                out |= power
            if (power := cross(power, one)) is None:
                return None
        return out if len(out) <= MOST else None
    return None


def sequence_strings(nodes) -> set[str] | None:
    out: set[str] | None = {""}
    for n in nodes:
        one = alternatives(n)
        out = None if one is None else cross(out, one)
        if out is None:
            return None
    return out


def query_of(nodes) -> Query:
    """The trigrams that every match of a parsed sequence must have."""
    parts, run = [], {""}
    for n in nodes:
        one = alternatives(n)
        joined = None if one is None else cross(run, one)
        if joined is not None:
            run = joined
            continue
        parts.append(of_strings(run))
        run = one if one is not None else {""}
        if one is None:
            op, arg = n
            if op is C.SUBPATTERN:
                parts.append(query_of(arg[-1]))
            elif op is C.BRANCH:
                parts.append(both("any", [query_of(x) for x in arg[1]]))
            elif op is C.MAX_REPEAT and arg[0] >= 1:
                parts.append(query_of(arg[2]))
    parts.append(of_strings(run))
    return both("all", parts)


def trigram_query(regex: str) -> Query:
    """The Boolean trigram query of a regex over lower-cased text."""
    return query_of(parser.parse(regex))


def trigrams(q: Query) -> set[str]:
    return {q} if isinstance(q, str) else set() if q is True else set().union(*(trigrams(x) for x in q[1]))


def holds(q: Query, has: dict[str, Column]) -> Column:
    """The query over columns that say which trigrams a document has."""
    if q is True:
        return F.lit(True)
    if isinstance(q, str):
        return has[q]
    return reduce(lambda a, b: a & b if q[0] == "all" else a | b, [holds(x, has) for x in q[1]])


#: Candidates (a key and a few kinds, about 100 bytes) that are broadcast, counted first; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


# --- the index ---------------------------------------------------------------------------------------------------------------------------------
def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that the queries name, for docs(doc_id, text)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    present = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    return docs.select("doc_id", low.alias("low")).select("doc_id", F.explode(present).alias("trigram")).select("trigram", "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds array<string>): postings intersected and united as the queries say."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not True}
    grams = sorted(set().union(*(trigrams(q) for q in queries.values())))
    mine = index.groupBy("doc_id").agg(*[F.max(F.col("trigram") == F.lit(g)).alias(f"t{i}") for i, g in enumerate(grams)])
    has = {g: F.col(f"t{i}") for i, g in enumerate(grams)}
    kinds = F.filter(F.array(*[F.when(holds(q, has), F.lit(k)) for k, q in queries.items()]), lambda k: k.isNotNull())
    return mine.select("doc_id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


# --- verification ------------------------------------------------------------------------------------------------------------------------------
SPAN = "array<struct<start:int,kind:int,end:int,keep:boolean>>"


def matches(text: Column, rule: Rule, kind: int) -> Column:
    """array<struct<start, kind, end, keep>> of a rule's matches in a text, by position."""
    found = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    between = F.split(text, rule.java, -1)
    groups = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)) if rule.group else found
    lens = F.zip_with(F.zip_with(between, found, lambda b, f: F.struct(F.length(b).alias("b"), F.length(f).alias("f"))), groups, lambda x, g: F.struct(x["b"].alias("b"), x["f"].alias("f"), F.length(g).alias("g")))
    lens = F.slice(lens, 1, F.size(found))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["b"] + x["f"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["b"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["b"] + x["f"]).alias("end"), (x["g"] >= rule.least).alias("keep")))).alias("out"),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.filter(F.aggregate(lens, none, step, lambda acc: acc["out"]), lambda s: s["keep"])


def found_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with spans array<struct<start, kind, end, keep>>, ordered by start and kind (its place in rules), for every row of docs(doc_id, text, ...).

    A column of docs that is called spans is replaced. The candidates are written first: few are broadcast, so that texts are not shuffled.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    grams = sorted(set().union(*(trigrams(q) for q in queries.values())))
    # rows without an id have their text's hash as key, so that they are not one key; equal keys only add candidates
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    cand = candidates(build_index(docs.select(key.alias("doc_id"), "text"), grams), rules)
    cand = written(cand.select(F.col("doc_id").alias("__carrel_key"), F.col("kinds").alias("__carrel_kinds")), "secrets-candidates")
    few = cand.count() <= BROADCAST_ROWS
    d = docs.withColumn("__carrel_key", key).join(F.broadcast(cand) if few else cand, "__carrel_key", "left").drop("__carrel_key")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(SPAN)
    spans = []
    for i, r in enumerate(rules):
        here = F.regexp_like(text, F.lit(r.java))
        if queries[r.kind] is not True:
            here = F.coalesce(F.array_contains("__carrel_kinds", r.kind), F.lit(False)) & here
        spans.append(F.when(here, matches(text, r, i)).otherwise(none))
    return d.withColumn("spans", F.array_sort(F.concat(*spans))).drop("__carrel_kinds")


def shown(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs(doc_id, text, ...) with the found spans of each text replaced by a mark; overlapping spans by one."""
    d = found_spans(docs, rules)
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out")),
    ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    return d.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))).drop("spans")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, base kinds and public formats."""
    d = found_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return d.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(shown(base, RULES).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans"), RULES).alias("spans"),
    )


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, kind, end) by plain regex search, for tests."""
    out = []
    for i, r in enumerate(rules):
        flags = re.ASCII | (re.IGNORECASE if r.any_case else 0)
        out += [(m.start(), i, m.end()) for m in re.finditer(r.regex, text or "", flags) if len(m[r.group]) >= r.least]
    return sorted(out)


def rule_sql(i: int, r: Rule) -> str:
    """(doc_id, start, kind, end) of one rule in DuckDB."""
    regex = "".join(f"[{c}{c.upper()}]" if r.any_case and c.isalpha() and c.islower() else c for c in r.regex.split("[")[0])
    regex = (regex + "[" + "[".join(r.regex.split("[")[1:]) if "[" in r.regex else regex).replace("'", "''")
    if r.any_case:  # letters before the first class and in api_?key, the classes have both cases
        regex = regex.replace("\\[xX]", "\\x")
    return f"""SELECT doc_id, st AS s, {i} AS k, st + f AS e FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda j: {{'st': CAST(list_sum(list_transform(b[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS BIGINT),
    'f': CAST(length(m[j]) AS BIGINT), 'g': CAST(length(g[j]) AS BIGINT)}}), recursive := true)
  FROM (SELECT doc_id, regexp_extract_all(t, '{regex}') AS m, regexp_extract_all(t, '{regex}', {r.group}) AS g, string_split_regex(t, '{regex}') AS b FROM d)
) WHERE g >= {r.least}"""


OP5_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\nx AS ("
    + "\nUNION ALL ".join(rule_sql(i, r) for i, r in enumerate(RULES))
    + "),\nnames AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{r.kind}')" for i, r in enumerate(RULES))
    + """) AS v(k, kind)),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM x JOIN names USING (k) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""
)
