r"""Secret scans by a trigram inverted index, JVM-side.

Each rule is a regular expression; a Boolean query over trigrams is derived from it (AND within a literal, OR between
alternatives). The index holds, for every trigram that some query asks for, the ids of the texts whose lower-cased form
contains it, in lists of bounded length (texts are spread over blocks); one pass of one expression finds all trigrams of a
text. A query intersects and unites lists block by block; only the candidates are then matched. A rule without a mandatory
trigram, such as a run of hexadecimal digits, scans every text.

Matches are leftmost and non-overlapping per rule, then those whose secret is shorter than the rule's least length go.
Spans are code points, end exclusive. Positions are running sums in blocks, so a text of very many matches takes time in
proportion to them.

Defined results: a null text is empty; rows with a null id are scanned without the index; repeated rows give equal rows;
an empty table gives no rows; other columns are kept (scan, redact), and a new column whose name is taken gets a "_" behind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import count, product
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import Workspace, free, partitions

MOST = 64
#: Up to so many candidate ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Values of a running sum that are folded together.
RUN = 256
NONE = "cast(array() as array<struct<start:int,at:int,end:int,kind:string,size:int>>)"


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    least: int = 0


RULES = (
    Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]+"),
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


# --- from a regex to a Boolean query: None stands for any text; ("and", ...), ("or", ...) or a trigram otherwise.


def _all(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _strings(exact: set[str]) -> object:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(exact)]) if exact else None


def _walk(seq) -> tuple[set[str] | None, list]:
    """The exact strings that a sequence matches, if few, else None, and queries that hold beside them."""
    exact, held = {""}, []

    def flush():
        nonlocal exact
        held.append(_strings(exact))
        exact = {""}

    for op, arg in seq:
        if op is C.LITERAL:
            found, more = {chr(arg).lower()}, []
        elif op is C.IN and len(arg) <= 6 and all(o is C.LITERAL for o, _ in arg):
            found, more = {chr(a).lower() for _, a in arg}, []
        elif op is C.SUBPATTERN:
            found, more = _walk(arg[-1])
        elif op is C.BRANCH:
            subs = [_walk(s) for s in arg[1]]
            if all(e is not None and not h for e, h in subs):
                found, more = set().union(*(e for e, _ in subs)), []
            else:
                found, more = None, [_any([_all([*h, _strings(e) if e else None]) for e, h in subs])]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            lo, hi, sub = arg
            e, h = _walk(sub)
            if e is not None and not h and lo == 0 and hi == 1:
                found, more = e | {""}, []
            else:
                found, more = None, ([*h, _strings(e) if e else None] if lo else [])
        elif op is C.AT:
            continue
        else:
            found, more = None, []
        held += more
        if found is None:
            flush()
        elif len(exact) * len(found) > MOST:
            flush()
            exact = found
        else:
            exact = {a + b for a, b in product(exact, found)}
            continue
        if found is None:
            exact = {""}
    if not held and len(exact) <= MOST:
        return exact, []
    return None, [h for h in [*held, _strings(exact)] if h is not None]


def trigram_query(regex: str) -> object:
    """What the lower-cased text of any match contains; None if nothing is mandatory."""
    exact, held = _walk(P.parse(regex))
    return _strings(exact) if exact is not None else _all(held)


def conjunctions(query: object) -> list[tuple[str, ...]]:
    """A query as alternatives of trigrams that all must occur. An alternative that asks for more than another is dropped."""
    if isinstance(query, str):
        alternatives = [frozenset([query])]
    elif query[0] == "or":
        alternatives = [frozenset(c) for q in query[1:] for c in _product([q])]
    else:
        alternatives = _product(query[1:])
    return sorted(tuple(sorted(a)) for a in set(alternatives) if not any(b < a for b in alternatives))


def _product(queries) -> list[frozenset]:
    out = [frozenset()]
    for q in queries:
        options = [frozenset([q])] if isinstance(q, str) else [frozenset(c) for x in q[1:] for c in _product([x])] if q[0] == "or" else _product(q[1:])
        out = [a | b for a in out for b in options]
    return out


def asked(rules) -> dict[str, list[tuple[str, ...]]]:
    return {r.kind: conjunctions(q) for r in rules if (q := trigram_query(r.regex)) is not None}


# --- index and candidates


def vocabulary(rules) -> list[str]:
    return sorted({t for cs in asked(rules).values() for c in cs for t in c})


def one_pass(trigrams: list[str]) -> str:
    """An expression that matches, without consuming, wherever one of the trigrams begins; letters are shared as in a tree."""

    def tree(words: list[str]) -> str:
        heads = sorted({w[0] for w in words})
        parts = [re.escape(h) + (tree(sorted({w[1:] for w in words if w[0] == h})) if len(words[0]) > 1 else "") for h in heads]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return f"(?=({tree(trigrams)}))"


def build_index(docs: DataFrame, id_col: str, text_col: str, rules, ws: Workspace, name: str = "postings") -> DataFrame:
    """(block, trigram, ids): the inverted index over the trigrams that the rules ask for."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    held = F.array_distinct(F.regexp_extract_all(low, F.lit(one_pass(vocabulary(rules))), F.lit(1)))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(held).alias("trigram"))
    blocks = 4 * partitions(docs.sparkSession)
    return ws.save(rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("id").alias("ids")), name)


def candidates(index: DataFrame, rules) -> DataFrame:
    """(id, kinds): which rules' queries a text meets, by intersecting and uniting posting lists within each block."""
    want = asked(rules)
    at = {t: f"t{i}" for i, t in enumerate(vocabulary(rules))}
    empty = f"cast(array() as {index.schema['ids'].dataType.simpleString()})"
    lists = [f"coalesce(first(case when trigram = {quoted(t)} then ids end, true), {empty}) as {c}" for t, c in at.items()]
    wide = index.groupBy("block").agg(*map(F.expr, lists))
    one = lambda c: reduce(lambda a, t: f"array_intersect({a}, {at[t]})", c[1:], at[c[0]])
    found = {k: reduce(lambda a, c: f"array_union({a}, {one(c)})", cs[1:], one(cs[0])) for k, cs in want.items()}
    each = ", ".join(f"named_struct('kind', {quoted(k)}, 'ids', {x})" for k, x in found.items())
    hits = wide.select(F.expr(f"explode(array({each})) as x")).selectExpr("x.kind", "explode(x.ids) as id")
    return hits.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


# --- expressions as SQL text: a tree of some thousand nodes is parsed at once, instead of built call by call


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_serial = count()


def let(value: str, body) -> str:
    x = f"x{next(_serial)}"
    return f"element_at(transform(array({value}), {x} -> {body(x)}), 1)"


def running(values: str, zero: str, step) -> str:
    """[zero, step(zero, v1), step(step(zero, v1), v2), ...]: running values, one more than there are values. Blocks are folded
    apart and then carried on, as appending to one array would copy it each time; `step` is associative."""
    fold = lambda part: f"aggregate({part}, array({zero}), (a, v) -> concat(a, array({step('element_at(a, -1)', 'v')})))"
    blocks = lambda vs: f"transform(sequence(0, greatest(cast(ceil(size({vs}) / {RUN}) as int) - 1, 0)), k -> {fold(f'slice({vs}, k * {RUN} + 1, {RUN})')})"
    carried = lambda bs: fold(f"transform({bs}, b -> element_at(b, -1))")
    whole = lambda bs, c: f"flatten(zip_with({bs}, slice({c}, 1, size({bs})), (b, y) -> transform(slice(b, 2, size(b)), v -> {step('y', 'v')})))"
    return let(let(values, blocks), lambda bs: f"concat(array({zero}), {let(carried(bs), lambda c: whole(bs, c))})")


def spans(text: str, rule: Rule, order: int) -> str:
    """[(start, at, end, kind, size)] of one rule: a match begins where the gaps and the matches before it end."""
    pattern = quoted(rule.regex)

    def place(m: str) -> str:
        secrets = f"regexp_extract_all({text}, {pattern}, {rule.group})" if rule.group else m
        parts = f"zip_with(slice(split({text}, {pattern}, -1), 1, size({m})), {m}, (g, x) -> named_struct('both', length(g) + length(x), 'long', length(x)))"
        ends = lambda p: f"slice({running(f'transform({p}, x -> x.both)', '0', lambda a, v: f'({a} + {v})')}, 2, size({p}))"
        span = f"named_struct('start', e - x.m.long, 'at', {order}, 'end', e, 'kind', {quoted(rule.kind)}, 'size', length(x.s))"
        each = let(parts, lambda p: f"zip_with({ends(p)}, zip_with({p}, {secrets}, (m, s) -> named_struct('m', m, 's', s)), (e, x) -> {span})")
        return f"filter({each}, s -> s.size >= {rule.least})"

    return let(f"regexp_extract_all({text}, {pattern}, 0)", lambda m: f"case when size({m}) > 0 then {place(m)} else {NONE} end")


def scan(docs: DataFrame, id_col: str, text_col: str, ws: Workspace, rules=RULES, name: str = "found") -> DataFrame:
    """The rows with a column `found`: all spans in order of start, then of rule."""
    hits = ws.save(candidates(build_index(docs, id_col, text_col, rules, ws), rules), "candidates")
    n = hits.count()
    ident, kinds, name = free(docs.columns, "__id"), free(docs.columns, "__kinds"), free(docs.columns, name)
    hits = hits.withColumnsRenamed({"id": ident, "kinds": kinds})
    rows = docs.join(F.broadcast(hits) if n <= BROADCAST_IDS else hits, F.col(id_col) == F.col(ident), "left")
    each = []
    for i, r in enumerate(rules):
        s = spans(f"coalesce(`{text_col}`, '')", r, i)
        if trigram_query(r.regex) is not None:
            s = f"case when array_contains(`{kinds}`, {quoted(r.kind)}) or `{id_col}` is null then {s} else {NONE} end"
        each.append(s)
    return rows.withColumn(name, F.expr(f"array_sort(concat({', '.join(each)}))")).drop(ident, kinds)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str, text_col: str, ws: Workspace, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span of their text replaced; spans that overlap or touch are one."""
    name = free(docs.columns, "__found")
    rows = scan(docs, id_col, text_col, ws, rules, name)
    found, text = f"`{name}`", f"`{text_col}`"

    def put(far: str) -> str:
        """Parts between spans: far is the farthest end before each span; one that begins beyond it begins a new part."""
        head = f"zip_with({found}, slice({far}, 1, size({found})), (s, f) -> named_struct('start', s.start, 'far', f))"
        starts = lambda new: f"concat(transform({new}, x -> x.start), array(length({text})))"
        ends = lambda new: f"concat(array(0), transform(slice({new}, 2, size({new})), x -> x.far), array(element_at({far}, -1)))"
        return let(f"filter({head}, x -> x.start > x.far)", lambda new: f"array_join(zip_with({ends(new)}, {starts(new)}, (a, b) -> substring({text}, a + 1, b - a)), {quoted(mark)})")

    clean = let(running(f"transform({found}, s -> s.end)", "-1", lambda a, v: f"greatest({a}, {v})"), put)
    return rows.withColumn(text_col, F.expr(f"case when size({found}) > 0 then {clean} else {text} end")).drop(name)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scan(docs, "doc_id", "text", Workspace(spark, "secrets")).drop("text")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return rows.select("doc_id", *map(count, BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    each = []
    for i, r in enumerate(RULES):
        add = lambda part: f"coalesce(list_sum([length(x) for x in {part}]), 0)::BIGINT"
        each.append(
            f"(with m as (select regexp_extract_all(t, '{q(r.regex)}', 0) as m, regexp_extract_all(t, '{q(r.regex)}', {r.group}) as s, string_split_regex(t, '{q(r.regex)}') as g) "
            f"select [{{'start': {add('g[1:i]')} + {add('m[1:i-1]')}, 'at': {i}, 'end': {add('g[1:i]')} + {add('m[1:i]')}, 'kind': '{r.kind}'}} for i in range(1, len(m) + 1) if length(s[i]) >= {r.least}] from m)"
        )
    text = lambda part: f"array_to_string([s.kind || ':' || s.start || ':' || s.end for s in {part}], ',')"
    n = ", ".join(f"len([s for s in f if s.kind = '{k}'])::BIGINT as n_{k}" for k in BASE)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
x as (select doc_id, list_sort({" || ".join(each)}) as f from d)
select doc_id, {n}, sha256({text("[s for s in f if s.at < 3]")}) as base_sha256, {text("f")} as spans from x"""


QUERIES = {"op3_secret_scan": op3}
SQL = {"op3_secret_scan": _sql()}
