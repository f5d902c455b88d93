"""Raw episodes to security events: a projection of the JSON in `content`, the same over tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSER, VERSION = "chronolith.generic", "1.0.0"
SOURCES = {
    "auditd": "auditd linux_audit", "windows_event_log": "windows windows_event_log wineventlog", "cloudtrail": "cloudtrail aws", "azure_activity": "azure azure_activity", "gcp_audit": "gcp gcp_audit",
    "kubernetes_audit": "kubernetes k8s", "nginx": "nginx", "envoy": "envoy", "postgresql": "postgres postgresql", "mysql": "mysql", "iam": "iam", "oauth": "oauth", "opentelemetry": "otel opentelemetry", "application": "application app",
}
CATEGORIES = {
    "authentication": "authentication auth iam", "authorization": "authorization access", "network": "network dns http", "process": "process execution", "file": "file filesystem", "cloud": "cloud", "identity": "identity", "discovery": "discovery", "findings": "findings finding",
}
OUTCOMES = {"success": "success succeeded ok pass", "failure": "failure failed fail denied", "blocked": "blocked", "allowed": "allowed allow", "error": "error exception"}


def first_present(raw: Column, keys: list[str]) -> Column:
    """The value of the first key that the object (a map of texts) has, whatever it is; null if none."""
    return F.coalesce(*(raw[k] for k in keys))


def text(raw: Column, keys: list[str]) -> Column:
    v = F.trim(first_present(raw, keys))
    return F.when((v != "") & ~v.rlike(r"^[\[{]"), v)


def number(raw: Column, keys: list[str]) -> Column:
    return F.coalesce(F.when(first_present(raw, keys).rlike("^[0-9]{1,18}$"), first_present(raw, keys)).cast("long"), F.lit(0))


def mapped(value: Column, names: dict[str, str]) -> Column:
    """A known spelling's name, else the value itself."""
    low, out = F.lower(value), value
    for name, spellings in names.items():
        out = F.when(low.isin(*spellings.split()), name).otherwise(out)
    return out


def entity(raw: Column, keys: list[str]) -> Column:
    """An id given as text, or an object's id or name."""
    v = first_present(raw, keys)
    return F.when(v.startswith("{"), F.coalesce(F.get_json_object(v, "$.id"), F.get_json_object(v, "$.name"))).when((F.trim(v) != "") & ~v.startswith("["), F.trim(v))


def endpoint(raw: Column, keys: list[str]) -> Column:
    """ip:port, or what of it is there."""
    v = first_present(raw, keys)
    host = F.when(v.startswith("{"), F.coalesce(F.get_json_object(v, "$.ip"), F.get_json_object(v, "$.domain"), F.get_json_object(v, "$.hostname"))).otherwise(F.when(F.trim(v) != "", F.trim(v)))
    return F.concat_ws(":", host, F.when(v.startswith("{"), F.get_json_object(v, "$.port")))


def normalize(episodes: DataFrame, own_agent: str = "detector") -> DataFrame:
    """(lsn, source, category, activity, outcome, severity, observed_at, type_uid, principal, user, host, process, session,
    resource, src, dst, fidelity, parser_id, parser_version). Events that detection itself derived are no raw telemetry."""
    own = (F.col("agent_id") == own_agent) & F.coalesce(F.col("attrs")[f"{own_agent}.generated"].isin("true", "derived", "1"), F.lit(False))
    raw = F.col("__raw")
    source = F.coalesce(mapped(text(raw, ["source", "source_type"]), SOURCES), F.col("agent_id"))
    category = F.coalesce(mapped(text(raw, ["category", "security.category"]), CATEGORIES), F.lit("unmapped"))
    activity = F.coalesce(text(raw, ["activity", "event", "action", "security.activity"]), F.lit("unmapped"))
    outcome = F.coalesce(mapped(text(raw, ["outcome", "status", "result"]), OUTCOMES), F.lit("unknown"))
    some = lambda c: F.when(c != "", c)
    parsed = episodes.where(~own).withColumn("__raw", F.from_json("content", "map<string,string>"))  # once a row
    out = parsed.select(
        "lsn", source.alias("source"), category.alias("category"), activity.alias("activity"), outcome.alias("outcome"),
        F.least(number(raw, ["severity", "severity_id", "risk"]), F.lit(255)).alias("severity"), number(raw, ["observed_at", "timestamp", "time", "event_time"]).alias("observed_at"), number(raw, ["type_uid", "ocsf.type_uid"]).alias("type_uid"),
        entity(raw, ["principal", "principal_id"]).alias("principal"), entity(raw, ["user", "user_id", "username"]).alias("user"), entity(raw, ["host", "host_id", "hostname"]).alias("host"), entity(raw, ["process", "process_name"]).alias("process"),
        entity(raw, ["session", "session_id"]).alias("session"), F.coalesce(*(entity(raw, [k, f"{k}_id"]) for k in ("resource", "database", "file", "repository"))).alias("resource"),
        some(endpoint(raw, ["src", "source_endpoint"])).alias("src"), some(endpoint(raw, ["dst", "destination_endpoint"])).alias("dst"), raw.isNotNull().alias("object"),
    )
    fidelity = F.when((F.col("type_uid") != 0) & F.col("object"), "exact").when(F.col("object") & ((F.col("activity") != "unmapped") | (F.col("category") != "unmapped")), "partial").otherwise("unmapped")
    return out.withColumns({"fidelity": fidelity, "parser_id": F.lit(PARSER), "parser_version": F.lit(VERSION)}).drop("object")


ACTIVITIES = (("query", "queried"), ("read", "read"), ("write", "wrote"), ("download", "downloaded"), ("upload", "uploaded"), ("delete", "deleted"), ("modify", "modified"), ("update", "modified"), ("escalat", "escalated_to"))


def security_edges(events: DataFrame) -> DataFrame:
    """(lsn, src, dst, etype): the six rules by which a normalised event implies edges; each edge of an event once."""
    c = F.col
    good = c("outcome").isin("success", "allowed")
    low = F.lower(c("activity"))
    act = F.lit("accessed")
    for word, name in reversed(ACTIVITIES):
        act = F.when(low.contains(word), name).otherwise(act)
    who, principal = F.coalesce("user", "principal"), F.coalesce("principal", "user")
    rules = [
        (c("user"), c("session"), F.lit(True), F.lit("created_session")), (who, c("host"), c("category").isin("authentication", "identity") & good, F.lit("authenticated_to")), (c("session"), c("host"), F.lit(True), F.lit("active_on")),
        (c("host"), c("process"), (c("category") == "process") | low.contains("spawn"), F.lit("spawned")), (c("process"), c("dst"), F.lit(True), F.lit("connected_to")), (principal, c("resource"), F.lit(True), act),
    ]
    each = F.array(*(F.when(a.isNotNull() & b.isNotNull() & F.coalesce(test, F.lit(False)), F.struct(a.alias("src"), b.alias("dst"), t.alias("etype"))) for a, b, test, t in rules))
    return events.select("lsn", F.explode(F.array_distinct(F.array_compact(each))).alias("x")).select("lsn", "x.*")
