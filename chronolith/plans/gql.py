"""The query language: a recursive-descent parser and a planner from statements to DataFrames.

MATCH with WHERE, VALID AT, AS OF, RETURN, ORDER BY and LIMIT over nodes and single hops; CREATE; RECALL, NEAREST,
PROVENANCE, NEIGHBORS, TRAVERSE, FUSE, RESOLVE, CLUSTER, HYPOTHESES, WHY, COMMUNITY, METRICS, DECIDE, ADAPT; EXPLAIN,
REQUIRE LSN and SIMULATE before them. Words of the language are case-insensitive. AND binds tighter than OR.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import compare as C
from chronolith.functions.scalars import edge_key
from chronolith.operators import causal, decide, entity, graph, retrieval, text, vector
from chronolith.sources.shared import through

TOKEN = re.compile(r'\s*(?:(?P<rel>-\[)|(?P<end>\]->)|(?P<num>-?\d+(?:\.\d+)?)|(?P<str>"[^"]*")|(?P<word>[^\W\d_][\w]*)|(?P<op>!=|>=|<=|[=<>(){}\[\],.:*]))')
NUMBERS = {"lsn", "ts_hlc"}
BUILTIN = {"lsn", "id", "agent_id", "session_id", "kind", "content", "ts_hlc"}
ROW = ["lsn", "id", "agent_id", "session_id", "kind", "content", "attrs", "ts_hlc", "parents"]
EDGE_ORDER = {"id": "edge_id", "type": "etype", "belief": "belief", "from": "src", "to": "dst"}
SIMULATIONS = 8


class GqlError(ValueError):
    pass


@dataclass
class Statement:
    kind: str
    args: dict = field(default_factory=dict)
    explain: bool = False
    require: int | None = None
    simulate: list = field(default_factory=list)


class Parser:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise GqlError(f"unexpected text at {at}: {source[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.i = 0

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.tokens[self.i + n] if self.i + n < len(self.tokens) else ("end-of-query", "")

    def word(self, *want: str) -> bool:
        """Takes the words if they come next."""
        if all(self.peek(k)[0] == "word" and self.peek(k)[1].upper() == w for k, w in enumerate(want)):
            self.i += len(want)
            return True
        return False

    def op(self, want: str) -> bool:
        if self.peek()[1] == want and self.peek()[0] in ("op", "rel", "end"):
            self.i += 1
            return True
        return False

    def need(self, want: str) -> None:
        if not (self.op(want) or self.word(want.upper())):
            raise GqlError(f"expected {want!r}, found {self.peek()[1]!r}")

    def take(self, kind: str) -> str:
        k, v = self.peek()
        if k != kind:
            raise GqlError(f"expected {kind}, found {v!r}")
        self.i += 1
        return v

    def string(self) -> str:
        return self.take("str")[1:-1]

    def integer(self) -> int:
        v = self.take("num")
        if not v.isdigit():
            raise GqlError(f"expected a whole number, found {v}")
        return int(v)

    def literal(self):
        k, v = self.peek()
        self.i += 1
        if k == "str":
            return v[1:-1]
        if k == "num":
            return int(v) if re.fullmatch(r"-?\d+", v) and abs(int(v)) >= C.EXACT else float(v)
        raise GqlError(f"expected a value, found {v!r}")

    def vector(self) -> list[float]:
        self.need("[")
        out = [float(self.take("num"))]
        while self.op(","):
            out.append(float(self.take("num")))
        self.need("]")
        return out

    # --- statements

    def parse(self) -> Statement:
        explain = self.word("EXPLAIN")
        require = None
        if self.word("REQUIRE"):
            self.need("LSN")
            self.need(">=")
            require = self.integer()
        sims = []
        while self.word("SIMULATE"):
            action = "ADD" if self.word("ADD") else "REMOVE" if self.word("REMOVE") else None
            if not action:
                raise GqlError("SIMULATE takes ADD or REMOVE")
            self.need("EDGE")
            self.need("(")
            a = self.string()
            self.need(",")
            b = self.string()
            self.need(",")
            t = self.string()
            self.need(")")
            self.need("THEN")
            sims.append((action, a, b, t))
            if len(sims) > SIMULATIONS:
                raise GqlError(f"more than {SIMULATIONS} SIMULATE")
        kind = self.take("word").upper()
        rule = getattr(self, f"s_{kind.lower()}", None)
        if rule is None:
            raise GqlError(f"unknown statement {kind}")
        out = Statement(kind, rule(), explain, require, sims)
        if self.peek()[0] != "end-of-query":
            raise GqlError(f"unexpected {self.peek()[1]!r}")
        return out

    def as_of(self) -> tuple[str, int] | None:
        if not self.word("AS"):
            return None
        self.need("OF")
        if self.word("LSN"):
            return "lsn", self.integer()
        self.need("TIMESTAMP")
        return "timestamp", self.integer()

    def node(self) -> tuple[str, str | None]:
        self.need("(")
        name = self.take("word")
        label = self.take("word") if self.op(":") else None
        self.need(")")
        return name, label

    def operand(self):
        k, v = self.peek()
        if k == "word" and v.upper() in ("DIST_PRODUCT", "DIST_HYP", "DIST_SPH", "DIST_EUC"):
            self.i += 1
            self.need("(")
            q = self.vector()
            self.need(")")
            return "dist", v.upper(), q
        if k == "word":
            self.i += 1
            return ("prop", v, self.take("word")) if self.op(".") else ("var", v)
        return "lit", self.literal()

    def s_match(self) -> dict:
        out = {"a": self.node(), "rel": None, "b": None, "where": [], "valid": None}
        if self.op("-["):
            name = self.take("word")
            out["rel"] = (name, self.take("word") if self.op(":") else None)
            self.need("]->")
            out["b"] = self.node()
        if self.word("WHERE"):
            groups = [[self.condition()]]
            while True:
                if self.word("AND"):
                    groups[-1].append(self.condition())
                elif self.word("OR"):
                    groups.append([self.condition()])
                else:
                    break
            out["where"] = groups
        if self.word("VALID"):
            self.need("AT")
            out["valid"] = self.integer()
        out["as_of"] = self.as_of()
        self.need("RETURN")
        items = [self.item()]
        while self.op(","):
            items.append(self.item())
        out["items"] = items
        out["order"] = None
        if self.word("ORDER"):
            self.need("BY")
            key = self.operand()
            if key[0] == "lit":
                raise GqlError("ORDER BY takes a property")
            out["order"] = (key, bool(self.word("DESC")) or (self.word("ASC") and False))
        out["limit"] = self.integer() if self.word("LIMIT") else None
        return out

    def condition(self):
        left = self.operand()
        k, op = self.peek()
        if op not in ("!=", ">=", "<=", "=", ">", "<"):
            raise GqlError(f"expected a comparison, found {op!r}")
        self.i += 1
        return left, op, self.operand()

    def item(self):
        if self.op("*"):
            return ("star",)
        v = self.take("word")
        return ("prop", v, self.take("word")) if self.op(".") else ("var", v)

    def s_create(self) -> dict:
        self.need("(")
        self.take("word")
        label = self.take("word") if self.op(":") else "Observation"
        props: dict[str, str] = {}
        if self.op("{"):
            while True:
                key = self.take("word")
                self.need(":")
                k, v = self.peek()
                self.literal()
                props[key] = v[1:-1] if k == "str" else v
                if not self.op(","):
                    break
            self.need("}")
        self.need(")")
        return {"label": label, "props": props}

    def _call(self, *kinds: str) -> list:
        self.need("(")
        out = []
        for i, k in enumerate(kinds):
            optional = k.endswith("?")
            if i:
                if optional and self.peek()[1] != ",":
                    out.append(None)
                    continue
                self.need(",")
            k = k.rstrip("?")
            out.append(self.string() if k == "s" else self.integer() if k == "i" else self.vector() if k == "v" else self.take("word").upper())
        self.need(")")
        return out

    def _named(self, names: str, *kinds: str) -> dict:
        return dict(zip(names.split(), self._call(*kinds), strict=True)) | {"as_of": self.as_of()}

    def s_recall(self):
        return self._named("text k", "s", "i")

    def s_nearest(self):
        return self._named("vector k", "v", "i")

    def s_provenance(self):
        return {"id": self._call("s")[0]}

    def s_neighbors(self):
        return self._named("node etype", "s", "s?")

    def s_traverse(self):
        return self._named("node depth", "s", "i")

    def s_fuse(self):
        return self._named("text vector anchor k", "s", "v", "s", "i")

    def s_resolve(self):
        return self._named("key", "s")

    def s_cluster(self):
        return self._named("entity", "s")

    def s_hypotheses(self):
        return self._named("src dst etype", "s", "s", "s")

    def s_why(self):
        ident, depth = self._call("s", "i?")
        until = self.string() if self.word("UNTIL") else None
        return {"id": ident, "depth": 64 if depth is None else depth, "until": until, "as_of": self.as_of()}

    def s_community(self):
        out = self._named("node how", "s", "w?")
        if out["how"] not in (None, "LEIDEN"):
            raise GqlError("COMMUNITY takes LEIDEN at most")
        return out

    def s_metrics(self):
        return self._named("node", "s")

    def s_decide(self):
        self._call_empty()
        return {"as_of": self.as_of()}

    s_adapt = s_decide

    def _call_empty(self) -> None:
        self.need("(")
        self.need(")")


def parse(source: str) -> Statement:
    return Parser(source).parse()


def required_access(source: str) -> str:
    return "write" if parse(source).kind in ("CREATE", "DECIDE") else "read"


class Log:
    """The log's tables: episodes; edge events; entity events with merge groups. Statements are planned against them."""

    def __init__(self, episodes: DataFrame, edge_events: DataFrame | None = None, entity_events: DataFrame | None = None, entity_groups: DataFrame | None = None, head: int | None = None, guard_rows: int | None = None, communities: bool = True):
        self.episodes, self.edge_events, self.guard_rows = episodes, edge_events, guard_rows
        self.entity_events, self.entity_groups = entity_events, entity_groups
        self._head = head
        self.communities = communities  # whether METRICS names the node's, which takes the components of the whole graph
        self.sink = None

    @property
    def spark(self):
        return self.episodes.sparkSession

    def head(self) -> int:
        """The lsn after the last."""
        if self._head is None:
            tops = [d.agg(F.max("lsn")).first()[0] for d in (self.episodes, self.edge_events) if d is not None]
            self._head = max((t for t in tops if t is not None), default=-1) + 1
        return self._head

    def bound(self, as_of) -> int:
        """LSN n shows lsn < n; TIMESTAMP t shows what comes before the first event later than t."""
        if as_of is None:
            return self.head()
        kind, n = as_of
        if kind == "lsn":
            return min(n, self.head())
        first = self.episodes.where(F.shiftrightunsigned("ts_hlc", 16) > n).agg(F.min("lsn")).first()[0]
        return self.head() if first is None else first

    # --- properties and conditions

    def _prop(self, name: str, e: str = "") -> tuple[Column, bool]:
        name = "kind" if name == "tipo" else name
        if name in BUILTIN:
            return F.col(name), name in NUMBERS
        return F.col("attrs")[name], False

    def _value(self, operand, variable: str) -> tuple[Column, bool, bool]:
        """A node operand as a Column, whether it is a number, whether it needs exact comparison."""
        if operand[0] == "lit":
            v = operand[1]
            if isinstance(v, str):
                return F.lit(v), False, False
            return (F.lit(v).cast("decimal(38,0)"), True, True) if isinstance(v, int) else (F.lit(v), True, False)
        if operand[0] == "dist":
            return vector.distance(operand[1], operand[2]), True, False
        if operand[0] == "prop" and operand[1] == variable:
            return *self._prop(operand[2]), False
        return F.lit(None).cast("string"), False, False

    def _conditions(self, groups, one) -> Column | None:
        if not groups:
            return None
        return reduce(Column.__or__, (reduce(Column.__and__, map(one, g)) for g in groups))

    def _node_condition(self, c, variable: str) -> Column:
        (left, ln, lb), (right, rn, rb) = self._value(c[0], variable), self._value(c[2], variable)
        return C.compare(c[1], left, right, ln, rn, lb or rb)

    def match_nodes(self, a: dict) -> DataFrame:
        variable, label = a["a"]
        bound = self.bound(a["as_of"])
        e = self.episodes.where(F.col("lsn") < bound)
        if label is not None:
            e = e.where(F.lower("kind") == label.lower())
        test = self._conditions(a["where"], lambda c: self._node_condition(c, variable))
        if test is not None:
            e = e.where(test)
        if a["valid"] is not None:
            e = e.where(valid_at(a["valid"]))
        tie = F.col("lsn")
        if a["order"]:
            key, down = a["order"]
            value, number, _ = self._value(key, variable)
            if key[0] == "dist":
                value = F.coalesce(value, F.lit(float("inf")))
                keys = [value.desc() if down else value.asc(), tie.asc()]
            else:
                keys = C.order_keys(value, number, down, tie)
            e = e.orderBy(*keys)
        elif a["limit"] is not None:
            e = e.orderBy(tie)
        if a["limit"] is not None:
            e = e.limit(a["limit"])
        out = []
        for item in a["items"]:
            if item[0] == "star" or item == ("var", variable):
                out += [F.col(c) for c in ROW if c not in [x for x in out if isinstance(x, str)]]
            elif item[0] == "prop" and item[1] == variable:
                value, _ = self._prop(item[2])
                out.append(value.alias(f"{item[1]}.{item[2]}"))
            else:
                out.append(F.lit(None).cast("string").alias(".".join(item[1:])))
        return self._guard(e.select(*out))

    def _guard(self, df: DataFrame) -> DataFrame:
        """With guard_rows set, a larger result is an error, never a part."""
        if self.guard_rows is not None and df.limit(self.guard_rows + 1).count() > self.guard_rows:
            raise GqlError(f"more than {self.guard_rows} rows; no partial result")
        return df

    # --- edges

    def edges(self, bound: int, events: DataFrame | None = None) -> DataFrame:
        return graph.edges_at(self.edge_events if events is None else events, bound)

    def match_edges(self, a: dict, events: DataFrame) -> DataFrame:
        (va, la), (vr, label), (vb, lb) = a["a"], a["rel"], a["b"]
        if la or lb:
            raise GqlError("labels on the nodes of a relationship pattern are not supported")
        bound = self.bound(a["as_of"])
        # What all alternatives ask of an end or the type precedes the shuffle on the edge.
        groups = a["where"]
        if label:
            events = events.where(F.col("etype") == edge_key(label))
        if len(groups) == 1:
            for left, op, right in groups[0]:
                if op == "=" and right[0] == "lit" and isinstance(right[1], str) and left[0] == "prop":
                    if left[1:] == (va, "id"):
                        events = events.where(F.col("src") == right[1])
                    elif left[1:] == (vb, "id"):
                        events = events.where(F.col("dst") == right[1])
        e = graph.edges_at(events, bound)
        if a["valid"] is not None and "world_from" in e.columns:
            e = e.where(graph.holds_at(a["valid"]))

        def value(o):
            if o[0] == "lit":
                return F.lit(o[1]), not isinstance(o[1], str)
            if o[0] == "dist":
                raise GqlError("distances need nodes")
            named = {(va, "id"): "src", (vb, "id"): "dst", (vr, "id"): "edge_id", (vr, "type"): "etype", (vr, "belief"): "belief", (vr, "from"): "src", (vr, "to"): "dst"}
            name = named.get(o[1:]) if o[0] == "prop" else {va: "src", vb: "dst", vr: "edge_id"}.get(o[1])
            return (F.col(name), name == "belief") if name else (F.lit(None).cast("string"), False)

        def one(c):
            (left, ln), (right, rn) = value(c[0]), value(c[2])
            test = C.compare(c[1], left, right, ln, rn)
            if c[0][1:] == (vr, "type") and c[2][0] == "lit" and isinstance(c[2][1], str) and c[1] in ("=", "!="):
                # A custom type is accepted with and without its prefix.
                test = C.compare(c[1], left, F.lit(edge_key(c[2][1])), False, False)
            return test

        test = self._conditions(groups, one)
        if test is not None:
            e = e.where(test)
        if a["order"]:
            key, down = a["order"]
            if key[0] != "prop" or key[2] not in EDGE_ORDER:
                raise GqlError("edges are ordered by id, type, belief, from or to")
            col = F.col(EDGE_ORDER[key[2]] if key[1] == vr else {"id": {va: "src", vb: "dst"}.get(key[1], "edge_id")}.get(key[2], "edge_id"))
            e = e.orderBy(col.desc() if down else col.asc(), "edge_id")
        elif a["limit"] is not None:
            e = e.orderBy("edge_id")
        if a["limit"] is not None:
            e = e.limit(a["limit"])
        out = []
        for item in a["items"]:
            if item[0] == "star":
                out += [F.col("src").alias("from"), F.col("dst").alias("to"), "edge_id", "etype", "belief"]
            else:
                out.append(value(item)[0].alias(".".join(item[1:])))
        return self._guard(e.select(*out))

    # --- statements

    def explain(self, s: Statement) -> str:
        a = s.args
        lines = [s.kind]
        if s.kind == "MATCH":
            lines[0] = "GraphMatch" if a["rel"] else "Match"
            if a["rel"] is None:
                hints = [c for g in a["where"] for c in g] if len(a["where"]) == 1 else []
                eq = [c for c in hints if c[1] == "=" and c[0][0] == "prop" and c[2][0] == "lit"]
                span = [c for c in hints if c[1] in (">", ">=", "<", "<=") and c[0][0] == "prop"]
                path = "AttrEq" if any(c[0][2] not in BUILTIN for c in eq) else "AttrRange" if any(c[0][2] not in BUILTIN for c in span) else "BuiltinSkip" if eq else "Label" if a["a"][1] else "Window"
                lines.append(f"  access: {path}")
            if a["valid"] is not None:
                lines.append(f"  valid at: {a['valid']}")
        if a.get("as_of"):
            lines.append(f"  as of {a['as_of'][0]}: {a['as_of'][1]}")
        for k in ("order", "limit"):
            if a.get(k) is not None:
                lines.append(f"  {k}: {a[k]}")
        for x in s.simulate:
            lines.insert(0, f"Simulate {x[0]} {x[1]} -[{x[3]}]-> {x[2]}")
        return "\n".join(lines)

    def query(self, source: str) -> DataFrame:
        s = parse(source)
        if s.explain:
            return self.spark.createDataFrame([(self.explain(s),)], "plan string")
        if s.require is not None and self.head() < s.require:
            raise GqlError(f"the log is at {self.head()}, before {s.require}")
        events = self.edge_events
        if s.simulate and events is not None:
            bound = self.bound(s.args.get("as_of"))
            for action, src, dst, t in s.simulate:
                events = graph.overlay(events, action, src, dst, edge_key(t), bound)
        return self._run(s, events)

    def _run(self, s: Statement, events: DataFrame | None) -> DataFrame:
        a = s.args
        k = s.kind
        if k == "MATCH":
            return self.match_edges(a, events) if a["rel"] else self.match_nodes(a)
        if k == "PROVENANCE":
            return causal.provenance(self.episodes, a["id"])
        if k == "CREATE":
            return self._create(a, dry=bool(s.simulate))
        bound = self.bound(a["as_of"])
        if k == "RECALL":
            return text.recall(self.episodes, a["text"], a["k"], bound)
        if k == "NEAREST":
            return vector.nearest(self.episodes, a["vector"], a["k"], bound=bound)
        if k == "NEIGHBORS":
            etype = None if a["etype"] is None else edge_key(a["etype"])
            return graph.neighbors(events, a["node"], bound, etype)
        if k == "TRAVERSE":
            return graph.traverse(events, a["node"], a["depth"], bound)
        if k == "HYPOTHESES":
            etype = edge_key(a["etype"])
            return graph.hypotheses(events, a["src"], a["dst"], etype, bound)
        if k == "WHY":
            if a["until"] is not None:
                return causal.why_until(self.episodes, a["id"], a["until"], a["depth"], bound)
            return causal.why(self.episodes, a["id"], a["depth"], bound)
        if k == "COMMUNITY":
            e = self.edges(bound, events)
            if a["how"] == "LEIDEN":
                from chronolith.operators.community import modular

                c = modular(e)
            else:
                c = graph.components(e)
            mine = c.where(F.col("node") == a["node"]).select("community")
            return c.join(F.broadcast(mine), "community").groupBy("community").agg(F.count(F.lit(1)).alias("members"))
        if k == "METRICS":
            e = graph.open_edges(events, bound)
            if not self.communities:
                return graph.metrics(e).where(F.col("node") == a["node"])
            e = through(e.select("src", "dst"), "edges")
            mine = graph.metrics(e).where(F.col("node") == a["node"])
            return mine.join(graph.components(e), "node", "left").select("node", "degree", "centrality", "anomaly", "community")
        if k in ("RESOLVE", "CLUSTER"):
            if self.entity_events is None:
                raise GqlError("the log has no entities")
            i = entity.resolver(self.entity_events.where(F.col("lsn") < bound), self.entity_groups)
            return entity.resolve(i, a["key"], bound) if k == "RESOLVE" else entity.cluster(i, a["entity"], bound)
        if k == "DECIDE":
            done = self.episodes.where("kind = 'Action'").select(F.col("attrs")["action_id"].alias("action_id")).where("action_id is not null")
            return decide.decide(graph.open_edges(events, bound), done)
        if k == "ADAPT":
            fb = self.episodes.where(F.col("lsn") < bound).where(F.col("attrs")["feedback_rule"].isNotNull())
            fb = fb.select(C.number(F.col("attrs")["score"]).alias("score"), (F.lower(F.col("attrs")["verdict"]) == "confirm").alias("confirmed")).where("score is not null")
            return decide.adapt(fb)
        if k == "FUSE":
            n = min(max(4 * a["k"], 8), 100_000)
            ids = self.episodes.select("lsn", "id")
            t = text.recall(self.episodes, a["text"], n, bound).join(ids, "lsn").select("id", "lsn", "score")
            v = vector.nearest(self.episodes, a["vector"], n, "DIST_HYP", bound).join(ids, "lsn").select("id", "lsn", (1 / (1 + F.col("distance"))).alias("score"))
            g = graph.neighbors(events, a["anchor"], bound).select(F.col("to").alias("id"), "lsn", F.col("belief").alias("score"))
            return retrieval.fuse(g, v, t, a["k"], bound)
        raise GqlError(k)

    def _create(self, a: dict, dry: bool) -> DataFrame:
        """One row at the head, appended to the sink (a path) if the log has one; under SIMULATE nothing is written."""
        label = {"action": "Action", "message": "Message", "observation": "Observation"}.get(a["label"].lower(), a["label"])
        lsn = self.head()
        attrs = F.create_map(*(F.lit(x) for kv in a["props"].items() for x in kv)) if a["props"] else F.expr("map()")
        from chronolith.sources.adapters import episode

        row = episode(self.spark.range(1), lsn=F.lit(lsn), id=F.lit(f"q{lsn}"), ts_hlc=F.shiftleft(F.unix_millis(F.current_timestamp()), 16), agent_id=F.lit("query"), kind=F.lit(label), content=F.lit(a["props"].get("content", "")), attrs=attrs)
        if not dry:
            if self.sink:
                row.write.mode("append").parquet(self.sink)
            self.episodes = self.episodes.unionByName(row)
            self._head = lsn + 1
        return self.spark.createDataFrame([(lsn,)], "lsn long")


def valid_at(t: int) -> Column:
    """(from null or from <= t) and (to null or t < to); the native field wins over the attribute of its name."""
    start = F.coalesce(F.col("valid_from").cast("double"), C.number(F.col("attrs")["valid_from"]))
    end = F.coalesce(F.col("valid_to").cast("double"), C.number(F.col("attrs")["valid_to"]))
    return (start.isNull() | (start <= t)) & (end.isNull() | (end > t))
