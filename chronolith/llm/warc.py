"""Content-addressed WARC archive.

Two tables stand for the archive: `blobs` (digest, payload) holds each payload's bytes once, in buckets of the digest;
`headers` (one row per record) holds the exact header block, its length and the payload's digest. Joined on the digest they give
the original record bytes; the blobs stay where they lie. Payloads that very many records share are joined apart, a record's
salt choosing one of several copies of the blob. The payload's key is SHA-256; reading back computes digests anew from the
bytes of the reconstructed records and fails where they are not what the header says. Everything is JVM-side.

Defined results: a null payload is empty; the largest id of a payload is its response (null ids are the smallest, and of
records with the same id, those with equal payloads share one role: all response or all revisit); repeated rows give as
many rows, each record with an id of its own; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import Workspace, partitions

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EPOCH = "2000-01-01T00:00:00Z"
#: A payload of more records is joined apart; of such payloads there are MOST at most.
SHARED, MOST = 10_000, 100_000
REFERS = "\\r\\nWARC-Refers-To: <urn:page:([^:>]*):[0-9]+>"


def base32(hex40: Column) -> Column:
    """Bare upper-case base32 of a 160-bit hexadecimal digest: eight groups of 20 bits, four letters each."""
    letters = []
    for g in range(8):
        n = F.conv(F.substring(hex40, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write_archive(df: DataFrame, id_col: str, url_col: str, payload_col: str, ws: Workspace, date: str = EPOCH) -> tuple[DataFrame, DataFrame]:
    """Writes and reads back (headers, blobs). Payloads are pre-aggregated before they move, so one that a third of all rows
    share moves once per task; everything else handles digests alone."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    index = ws.save(keyed.select("id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length"), F.monotonically_increasing_id().alias("serial")), "index")
    best = index.groupBy("digest").agg(F.max(F.struct("id", "serial")).alias("top"), F.count(F.lit(1)).alias("copies"))
    many = ws.save(best.where("copies > 1"), "shared")
    shared = max(SHARED, index.count() // MOST)
    # At most MOST payloads: a proven bound.
    near = index.join(F.broadcast(many.where(F.col("copies") > shared)), "digest", "left")
    far = near.where("copies is null").drop("top", "copies").join(many.where(F.col("copies") <= shared), "digest", "left")
    tagged = near.where("copies is not null").unionByName(far).withColumn("copies", F.coalesce("copies", F.lit(1)))
    kind = F.when(F.col("top").isNull() | F.col("id").eqNullSafe(F.col("top.id")), "response").otherwise("revisit")
    named = lambda ident, serial: F.concat(F.lit("<urn:page:"), F.coalesce(ident.cast("string"), F.lit("-")), F.lit(":"), serial.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), named(F.col("id"), F.col("serial")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "%0A")), F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.when(kind == "revisit", F.concat(F.lit("\r\nWARC-Refers-To: "), named(F.col("top.id"), F.col("top.serial")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1")), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("length").cast("string"), F.lit("\r\n\r\n"),
    )
    headers = ws.save(tagged.select("id", "digest", "copies", header.alias("header")).withColumn("header_bytes", F.octet_length("header")), "headers")
    blobs = ws.bucketed(keyed.groupBy("digest").agg(F.first("payload").alias("payload")), "blobs", partitions(df.sparkSession), "digest")
    return headers, blobs


def verified(blobs: DataFrame) -> DataFrame:
    """(digest, payload) of blobs whose stored bytes still have their digest; a damaged blob raises."""
    ok = F.sha2("payload", 256) == F.col("digest")
    return blobs.select("digest", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged blob "), F.col("digest"))).cast("binary")).alias("payload"))


def reconstruct(headers: DataFrame, blobs: DataFrame, shared: int = SHARED) -> DataFrame:
    """(id, header_bytes, record): original records, that is header block, payload and the closing blank lines, as bytes."""
    n = partitions(headers.sparkSession)
    whole = F.concat(F.encode("header", "UTF-8"), F.col("payload"), F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record")
    blobs = verified(blobs)
    few = headers.where(F.col("copies") <= shared).repartition(n, "digest").hint("shuffle_hash")
    most = headers.where(F.col("copies") > shared)
    salts = F.ceil(F.col("copies") / shared).cast("int")
    hot = most.groupBy("digest").agg(F.max("copies").alias("copies")).repartition(n, "digest")
    copies = blobs.join(hot.hint("shuffle_hash"), "digest").select("digest", "payload", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    salted = most.withColumn("salt", F.pmod(F.xxhash64("header"), salts).cast("int")).join(copies, ["digest", "salt"])
    return blobs.join(few, "digest").select("id", "header_bytes", whole).unionByName(salted.select("id", "header_bytes", whole))


def read_records(records: DataFrame) -> DataFrame:
    """Per record what its header says, with length and digest of the payload computed from the record's own bytes; one that
    disagrees with its header raises."""
    head = F.decode(F.substring(F.col("record"), F.lit(1), F.col("header_bytes")), "UTF-8")
    body = F.substring(F.col("record"), F.col("header_bytes") + 1, F.octet_length("record") - F.col("header_bytes") - 4)
    seen = records.select("id", head.alias("head"), body.alias("body")).select("id", "head", F.octet_length("body").cast("long").alias("payload_bytes"), base32(F.sha1("body")).alias("payload_digest"))
    field = lambda name: F.regexp_extract("head", f"\r\n{name}: ([^\r\n]*)", 1)
    fine = (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (field("Content-Length") == F.col("payload_bytes").cast("string"))
    refers = F.regexp_extract("head", REFERS, 1)
    return seen.select(
        "id", "payload_bytes", F.when(fine, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a record disagrees with its header: "), F.col("head"))).cast("string")).alias("payload_digest"),
        F.regexp_extract("head", "^WARC/1\\.1\r\nWARC-Type: ([a-z]+)", 1).alias("record_type"), F.when(refers != "", refers).alias("refers_to"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    headers, blobs = write_archive(pages, "page_id", "url", "html", Workspace(spark, "warc"))
    return read_records(reconstruct(headers, blobs)).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


_HEX = "sha1(encode(coalesce(html, '')))"
_B32 = " || ".join(f"substr('{ALPHABET}', 1 + ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) & 31)::BIGINT, 1)" for g in range(8) for s in (15, 10, 5, 0))
SQL = {
    "op10_warc": f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, {_HEX} as h, sha256(encode(coalesce(html, ''))) as d from pages),
q as (select *, max(page_id) over (partition by d) as top from p)
select page_id, n::BIGINT as payload_bytes, {_B32} as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from q"""
}
QUERIES = {"op10_warc": op10}
