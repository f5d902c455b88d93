"""Episodes and edges over tables: pure projections, so every filter and column list reaches the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPISODE = T.StructType(
    [
        T.StructField("lsn", T.LongType(), False), T.StructField("id", T.StringType()), T.StructField("ts_hlc", T.LongType()),
        T.StructField("agent_id", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("kind", T.StringType()),
        T.StructField("content", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("parents", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.StructType([T.StructField(x, T.ArrayType(T.DoubleType())) for x in ("hyp", "sph", "euc")])),
        T.StructField("valid_from", T.LongType()), T.StructField("valid_to", T.LongType()),
    ]
)
FIELDS = [f.name for f in EPISODE]


def episode(df: DataFrame, **cols) -> DataFrame:
    """An episode projection; fields not given take their defaults."""
    default = {"session_id": F.lit(""), "content": F.lit(""), "attrs": F.expr("map()"), "parents": F.expr("array()")}
    pick = lambda f: cols.get(f.name, default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
    return df.select(*map(pick, EPISODE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts) -> F.Column:
    return F.unix_millis(ts.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lsn = event_id; attributes value and k; valid from value (tenths) for half a thousand of them."""
    e = table(spark, sf_dir, "events")
    value = F.format_string("%.2f", F.col("value"))
    attrs = F.map_filter(F.create_map(F.lit("value"), value, F.lit("k"), F.get_json_object("props", "$.k"), F.lit("valid_to"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") + 500).cast("string"))), lambda _, v: v.isNotNull())
    return episode(
        e, lsn=F.col("event_id"), id=F.concat(F.lit("e"), F.col("event_id")), ts_hlc=F.shiftleft(millis(F.col("ts")), 16), agent_id=F.concat(F.lit("user-"), F.col("user_id")),
        session_id=F.concat(F.lit("s"), F.floor(F.col("event_id") / 100)), kind=F.col("event_type"), content=F.concat_ws(" ", F.lit("the"), "event_type", F.lit("event"), F.get_json_object("props", "$.k")), attrs=attrs,
        valid_from=F.when(F.col("event_id") % 2 == 0, F.col("event_id")),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episode(table(spark, sf_dir, "documents"), lsn=F.col("doc_id"), id=F.concat(F.lit("d"), F.col("doc_id")), agent_id=F.col("source"), kind=F.lit("Observation"), content=F.coalesce("text", F.lit("")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector on all three components: as it is, scaled into the ball, and on the sphere."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    e = F.struct(F.transform(v, lambda x: x * 0.5).alias("hyp"), F.transform(v, lambda x: x / norm).alias("sph"), v.alias("euc"))
    return episode(table(spark, sf_dir, "embeddings"), lsn=F.col("vec_id"), id=F.concat(F.lit("v"), F.col("vec_id")), agent_id=F.concat(F.lit("label-"), F.col("label")), kind=F.lit("Observation"), embedding=e)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns: each turn's parent is the one before; every third turn also has the first as a parent."""
    ident = lambda c, t: F.concat(F.lit("c"), c, F.lit("."), t)
    c, t = F.col("conv_id"), F.col("turn")
    parents = F.array_compact(F.array(F.when(t > 0, ident(c, t - 1)), F.when((t > 2) & (t % 3 == 0), ident(c, F.lit(0)))))
    return episode(table(spark, sf_dir, "conversations"), lsn=c * 1000 + t, id=ident(c, t), agent_id=F.col("role"), session_id=c, kind=F.lit("Message"), content=F.coalesce("text", F.lit("")), parents=parents)


def edge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lsn, src, dst, etype, op, confidence, polarity, hypothesis): orders and lineitems as assertions about who bought
    what from whom; a return is a retraction; nations lie in regions from the start."""
    li = table(spark, sf_dir, "lineitem")
    sells = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1000).alias("lsn"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.lit("custom:sells").alias("etype"),
        F.when(F.col("l_returnflag") == "R", "retract").otherwise("assert").alias("op"), F.round(0.5 + 4 * F.col("l_discount"), 4).alias("confidence"), F.when(F.col("l_linestatus") == "F", -1).otherwise(1).alias("polarity"), F.concat(F.lit("h"), F.col("l_linenumber")).alias("hypothesis"),
    )
    one = lambda df, lsn, src, dst, kind: df.select(lsn.cast("long").alias("lsn"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("etype"), F.lit("assert").alias("op"), F.lit(0.9).alias("confidence"), F.lit(1).alias("polarity"), F.lit("h0").alias("hypothesis"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    return (
        sells.unionByName(one(table(spark, sf_dir, "nation"), F.col("n_nationkey"), name("n", "n_nationkey"), name("r", "n_regionkey"), "custom:in"))
        .unionByName(one(table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 100 + 100, name("s", "s_suppkey"), name("n", "s_nationkey"), "custom:in"))
        .unionByName(one(table(spark, sf_dir, "customer"), F.col("c_custkey") % 100 + 300, name("c", "c_custkey"), name("n", "c_nationkey"), "custom:in"))
    )
