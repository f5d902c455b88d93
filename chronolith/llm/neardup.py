"""Near duplicates: a chosen-path set similarity join over word shingles.

Texts become sets of k-word shingles (A-Z lower-cased); texts with equal sets are one class. Each class has a minwise
signature of 64 coordinates. Every tree of a forest branches recursively: at a node one coordinate, with probability 1/4 a
second one, is selected by the node's own hash, and the node's members part by their token (minwise value) there, so a
pair of similarity 0.8 keeps an expected path alive. The first FIRST levels are branched before anything moves. Nodes of at
most LEAF members are compared exhaustively by a two-bit sketch of the signature; larger ones branch again, and very large
ones, found in a sample of the rows, without moving. Nodes still large at the last depth are groups of near copies: all
members are compared to one hub first, and whoever ends outside the hub's component is compared to every member, in salted
blocks. Candidate pairs are confirmed on the full sets, components follow from confirmed links.

Recall: with survival q(d) = 1 - (1 - s)(1 - s/4), s = J q(d-1), sixteen trees miss a pair of similarity 0.8 with
probability (1 - q)**16: 1e-9 at depth 2, 1e-6 at depth 4, and less above 0.8; the sketch drops it with about 1e-8.

Defined results: a null or empty text has no shingles and stands alone; with fewer than k words the whole sequence is the
one shingle; rows with a null id belong to the component of their class, or to none, and are kept only if alone; repeated
rows get equal results; of equal ids the component is the same, linked with what any of their texts is linked with; an empty
table gives no rows; other columns are ignored. Ids are integers; others raise TypeError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm import textcore as T
from chronolith.llm.common import Workspace, integral, ship
from chronolith.llm.graph import components

COORDS, TREES, LEAF, FIRST, DEPTH, SIGMAS = 64, 16, 32, 2, 6, 5.7
#: Partners of one document that are confirmed together: a text moves once for so many partners.
BLOCK = 1024
#: One row in SEEN shows which nodes are very large, of which at most HOT are broadcast (8 bytes each).
SEEN, HOT = 64, 1_000_000
#: Members of a node that are compared to its outsiders in one task.
SALTED = 4096
#: Up to so many candidate ids (8 bytes each) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
_rng = np.random.Generator(np.random.PCG64(977))
MULT = _rng.integers(1, 2**64 - 1, COORDS, dtype=np.uint64) | T.U(1)
ADD = _rng.integers(1, 2**64 - 1, COORDS, dtype=np.uint64)
ODD = T.U(0x5555555555555555)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each text, and where each text's begin (n + 1)."""
    _, _, h, first = T.words(data, off, T.LOWER)
    counts = np.diff(first)
    size = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner, rank = T.segments(size)
    at = first[:-1][owner] + rank
    out = T.mix(h[at] + T.U(1)) if len(at) else np.zeros(0, np.uint64)
    long = counts[owner] >= k
    for j in range(1, k):
        ok = long | (j < counts[owner])
        out[ok] = T.pair(out[ok], h[at[ok] + j], j)
    ptr = np.concatenate([[0], np.cumsum(size)])
    for i in range(len(size)):
        out[ptr[i] : ptr[i + 1]].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=len(size)))]).astype(np.int64)


def signatures(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Minwise values (n, COORDS) of non-empty sets, mixed to 32 bits."""
    out = np.empty((len(ptr) - 1, COORDS), np.uint32)
    for c in range(COORDS):
        out[:, c] = T.mix(np.minimum.reduceat(sets * MULT[c] + ADD[c], ptr[:-1])) >> T.U(32)
    return out


def sketches(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    two = (sig & 3).astype(np.uint64)
    shift = (np.arange(32) * 2).astype(np.uint64)
    return (two[:, :32] << shift).sum(1, dtype=np.uint64), (two[:, 32:] << shift).sum(1, dtype=np.uint64)


def least_agreement(share: float) -> int:
    p = share + (1 - share) / 4
    return int(COORDS * p - SIGMAS * (COORDS * p * (1 - p)) ** 0.5)


def children(keys: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Child keys of nodes, and the row each comes from. What a node selects depends on its key alone."""
    pick = T.mix(keys + T.U(0x51ED270B))
    one, two = (pick & T.U(63)).astype(np.int64), (pick >> T.U(6) & T.U(63)).astype(np.int64)
    row = np.arange(len(keys))
    a = T.pair(keys + one.astype(np.uint64), sig[row, one].astype(np.uint64), 3)
    more = np.flatnonzero((pick >> T.U(12) & T.U(3)) == 0)
    b = T.pair(keys[more] + two[more].astype(np.uint64), sig[more, two[more]].astype(np.uint64), 5)
    return np.concatenate([a, b]), np.concatenate([row, more])


ROOTS = T.mix(np.arange(1, TREES + 1, dtype=np.uint64) * T.U(0x2545F4914F6CDD1D))


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _set_table(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches):
        for b in batches:
            data, off = T.column(b.column(1))
            n = b.num_rows
            size, h0, h1 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            s0, s1 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sig: list = [None] * n
            for i, j in T.chunks(off):
                sets, ptr = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                have = np.flatnonzero(np.diff(ptr))
                size[i:j] = np.diff(ptr)
                if not len(have):
                    continue
                p = np.append(ptr[have], len(sets))
                m = signatures(sets, p)
                h0[i + have] = T.mix(np.add.reduceat(T.mix(sets + T.U(11)), p[:-1]))
                h1[i + have] = T.mix(np.add.reduceat(T.mix(sets ^ T.U(0x1234567)), p[:-1]))
                s0[i + have], s1[i + have] = sketches(m)
                for r, x in zip(have, m, strict=True):
                    sig[i + r] = x.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), _i64(h0), _i64(h1), _i64(s0), _i64(s1), pa.array(sig, pa.binary())], ["id", "n", "h0", "h1", "s0", "s1", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, h0 long, h1 long, s0 long, s1 long, sig binary")


ROW = "key long, rid long, n long, s0 long, s1 long"


def _expand(batches):
    """(keys or null for the roots, rid, n, s0, s1, sig) to child rows."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(n, COORDS)
        lists = b.column("keys").to_pylist()
        counts = np.array([TREES if x is None else len(x) for x in lists])
        keys = np.concatenate([ROOTS if x is None else np.array(x, np.int64).view(np.uint64) for x in lists])
        row = np.repeat(np.arange(n), counts)
        root = np.array([x is None for x in lists])
        for lo in range(0, len(keys), 1 << 16):
            at = row[lo : lo + (1 << 16)]
            kid, src = children(keys[lo : lo + (1 << 16)], sig[at])
            for _ in range(FIRST - 1):  # roots branch FIRST levels at once
                more = np.flatnonzero(root[at[src]])
                deep, up = children(kid[more], sig[at[src[more]]])
                rest = np.flatnonzero(~root[at[src]])
                kid, src = np.concatenate([kid[rest], deep]), np.concatenate([src[rest], src[more][up]])
            src = pa.array(at[src])
            yield pa.RecordBatch.from_arrays([_i64(kid), *(b.column(c).take(src) for c in ("rid", "n", "s0", "s1"))], ["key", "rid", "n", "s0", "s1"])


def _compare(num: int, den: int):
    agree = least_agreement(num / den)

    def run(batches):
        """Rows sorted by key: pairs (a, b) of small nodes that the sketch can't rule out, and (key, rid) of large nodes."""
        held = {c: np.zeros(0, np.int64) for c in ("key", "rid", "n", "s0", "s1")}
        big: list = []  # key of a large node that goes on

        def work(x: dict, last: bool):
            """Pairs and passed rows of all whole groups; the rest is held."""
            k = x["key"]
            cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(cut, len(k)))
            large = size > LEAF
            if big and k[0] == big[0]:
                large[0] = True
            keep_from = len(k)
            if not last:
                if large[-1]:
                    big[:] = [k[-1]]
                else:
                    keep_from = cut[-1]
                    big.clear()
            of = np.repeat(large, size)
            done = np.arange(len(k)) < keep_from
            rest = {c: v[keep_from:] for c, v in x.items()}
            passed = of & done
            small = np.flatnonzero(~of & done)
            y = {c: v[small] for c, v in x.items()}
            found = []
            s0, s1 = y["s0"].view(np.uint64), y["s1"].view(np.uint64)
            for o in range(1, LEAF):
                i = np.flatnonzero(y["key"][:-o] == y["key"][o:]) if len(small) > o else []
                if not len(i):
                    break
                d0, d1 = s0[i] ^ s0[i + o], s1[i] ^ s1[i + o]
                same = COORDS - np.bitwise_count((d0 | d0 >> T.U(1)) & ODD).astype(int) - np.bitwise_count((d1 | d1 >> T.U(1)) & ODD)
                a, b = y["n"][i], y["n"][i + o]
                i = i[(same >= agree) & (den * np.minimum(a, b) >= num * np.maximum(a, b))]
                a, b = y["rid"][i], y["rid"][i + o]
                found.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)])[a != b])
            p = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            return rest, pa.RecordBatch.from_arrays([pa.array(np.append(np.zeros(len(p), np.int32), np.ones(passed.sum(), np.int32))), pa.array(np.append(p[:, 0], k[passed])), pa.array(np.append(p[:, 1], x["rid"][passed]))], ["kind", "a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            x = {c: np.append(held[c], b.column(c).to_numpy(zero_copy_only=False)) for c in held}
            held, out = work(x, False)
            if out.num_rows:
                yield out
        if len(held["key"]):
            yield work(held, True)[1]

    return run


def _confirm(k: int, num: int, den: int):
    def run(batches):
        """Rows sorted by (a, part, role): the texts of a, then those of its partners."""
        now, sets_a = None, []
        for b in batches:
            data, off = T.column(b.column("text"))
            key = list(zip(b.column("a").to_pylist(), b.column("part").to_pylist(), strict=True))
            role, rid = b.column("role").to_pylist(), b.column("rid").to_pylist()
            links = []
            for i, j in T.chunks(off):
                flat, ptr = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                for r in range(i, j):
                    s = flat[ptr[r - i] : ptr[r - i + 1]]
                    if key[r] != now:
                        now, sets_a = key[r], []
                    if role[r] == 0:
                        sets_a.append(s.copy())
                        continue
                    for t in sets_a:
                        if not len(t) or not len(s):
                            continue
                        at = np.searchsorted(t, s)
                        both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                        if den * both >= num * (len(t) + len(s) - both):
                            links.append((key[r][0], rid[r]))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. A document with many partners is split into parts of BLOCK."""
    deg = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("deg"))
    parts = pairs.join(deg, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("deg") / BLOCK)).cast("int").alias("part"))
    need = parts.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("rid")).unionByName(parts.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("rid")).distinct())
    rows = need.join(texts, "rid").repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return rows.select("a", "part", "role", "rid", "text").mapInArrow(_confirm(k, num, den), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, ws: Workspace, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row; links at num / den of the union and above."""
    ship(docs.sparkSession)
    integral(docs, id_col)
    table = ws.save(_set_table(docs, id_col, text_col, k), "sets")
    some = table.where("n > 0 and id is not null")
    reps = ws.save(some.groupBy("h0", "h1").agg(F.min("id").alias("rid"), F.first("n").alias("n"), F.first("s0").alias("s0"), F.first("s1").alias("s1"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "classes")
    base = reps.select("rid", "n", "s0", "s1", "sig")
    rows = base.select(F.lit(None).cast("array<bigint>").alias("keys"), "rid", "n", "s0", "s1", "sig").mapInArrow(_expand, ROW)
    pairs, tail, depth = [], None, FIRST
    while True:
        rows = ws.save(rows, f"rows-{depth}", "lz4")
        # Nodes with more than LEAF rows in a sample are large for certain and branch anyway: they skip the shuffle.
        seen = rows.where(F.pmod(F.xxhash64("rid"), F.lit(SEEN)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        hot = ws.save(seen.where(F.col("c") > max(LEAF, rows.count() // SEEN // HOT)).select("key"), f"hot-{depth}")
        cold = rows.join(F.broadcast(hot), "key", "left_anti").repartition("key").sortWithinPartitions("key")
        out = ws.save(cold.mapInArrow(_compare(num, den), "kind int, a long, b long"), f"nodes-{depth}")
        pairs.append(out.where("kind = 0").select("a", "b"))
        large = out.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("rid")).unionByName(rows.join(F.broadcast(hot), "key", "left_semi").select("key", "rid"))
        large = ws.save(large, f"large-{depth}")
        ws.drop(f"rows-{depth}")
        if not large.take(1):
            break
        if depth == DEPTH:
            tail = large
            break
        lists = large.groupBy("rid").agg(F.collect_list("key").alias("keys"))
        rows = lists.join(base, "rid").select("keys", "rid", "n", "s0", "s1", "sig").mapInArrow(_expand, ROW)
        depth += 1
    if tail is not None:
        hubs = tail.groupBy("key").agg(F.min("rid").alias("a"))
        pairs.append(tail.join(hubs, "key").where("a <> rid").select("a", F.col("rid").alias("b")))
    found = pairs[0]
    for p in pairs[1:]:
        found = found.unionByName(p)
    links, stars = _settle(docs, id_col, text_col, found.distinct(), ws, "first", k, num, den)
    if tail is not None:
        # Members outside their hub's component are compared to all members of their node; for the others nothing can change.
        named = tail.join(stars.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", F.coalesce("component", "rid").alias("component"))
        named = named.join(hubs, "key").join(stars.select(F.col("node").alias("a"), F.col("component").alias("of")), "a", "left").withColumn("of", F.coalesce("of", "a"))
        outside = ws.save(named.where("component <> of").select("key", F.col("rid").alias("x")), "outside")
        if outside.take(1):
            asks = outside.join(stars.select(F.col("node").alias("x"), F.col("component").alias("cx")), "x", "left").withColumn("cx", F.coalesce("cx", "x"))
            # A node's members are spread over salts by its size, its outsiders go to all of them.
            salts = named.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("salts"))
            asks = asks.join(salts, "key").select("key", "x", "cx", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
            members = named.join(salts, "key").select("key", "rid", "component", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int").alias("salt"))
            more = members.join(asks, ["key", "salt"]).where("x <> rid and component <> cx")
            # Sketches rule out most before sets are read.
            sk = base.select("rid", "n", "s0", "s1")
            more = more.select(F.least("x", "rid").alias("a"), F.greatest("x", "rid").alias("b")).distinct()
            more = more.join(sk.withColumnsRenamed({"rid": "a", "n": "na", "s0": "p0", "s1": "p1"}), "a").join(sk.withColumnsRenamed({"rid": "b", "n": "nb", "s0": "q0", "s1": "q1"}), "b")
            odd = F.lit(0x5555555555555555)
            differ = lambda p, q: F.bit_count((p.bitwiseXOR(q)).bitwiseOR(F.shiftrightunsigned(p.bitwiseXOR(q), 1)).bitwiseAND(odd))
            more = more.where((COORDS - differ(F.col("p0"), F.col("q0")) - differ(F.col("p1"), F.col("q1")) >= least_agreement(num / den)) & (den * F.least("na", "nb") >= num * F.greatest("na", "nb")))
            more, _ = _settle(docs, id_col, text_col, more.select("a", "b"), ws, "second", k, num, den)
            stars = components(links.unionByName(more), ws, "all")
    named = reps.join(stars.withColumnRenamed("node", "rid"), "rid", "left").where("copies > 1 or component is not null").select("h0", "h1", F.coalesce("component", "rid").alias("component"))
    hold = table.select("id", F.col("n").alias("n_shingles"), "h0", "h1")
    got = hold.where("n_shingles > 0").join(named, ["h0", "h1"], "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    got = got.unionByName(hold.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))
    return got.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def drop_duplicates(docs: DataFrame, id_col: str, text_col: str, ws: Workspace, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component stays, that with the smallest id, with all columns; rows with a null id stay too. Rows
    that repeat an id lose all but one."""
    got = ws.save(near_duplicates(docs, id_col, text_col, ws, k, num, den), "verdicts")
    gone = got.where("not kept and id is not null").select(F.col("id").alias("__gone")).distinct()
    few = gone.count() <= BROADCAST_IDS
    rest = docs.join(F.broadcast(gone) if few else gone, F.col(id_col) == F.col("__gone"), "left_anti")
    if got.where("kept and id is not null").groupBy("id").count().where("count > 1").take(1):
        rest = rest.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(rest.where(F.col(id_col).isNull()))
    return rest


def _settle(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, ws: Workspace, name: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links, and their components."""
    pairs = ws.save(pairs, f"{name}-pairs")
    ids = ws.save(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), f"{name}-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text")).join(F.broadcast(ids) if few else ids, "rid", "left_semi")
    links = ws.save(confirm(pairs, texts, k, num, den), f"{name}-links")
    return links, components(links, ws, f"{name}-cc")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, "doc_id", "text", Workspace(spark, "neardup"), k=2).withColumnRenamed("id", "doc_id")


QUERIES = {"op8_minhash_neardup": op8}
SQL: dict[str, str] = {}
