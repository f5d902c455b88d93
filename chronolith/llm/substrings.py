"""Substring dedup by recompression, in Spark rounds.

Texts are parsed bottom up. A round forms symbols: first runs of equal tokens, then pairs of neighbours (one of a left, one
of a right class, by the name's own hash). Each round is a Spark step: every chunk of texts sends the names of the symbols that
it has formed, once each, to the bucket of the name; the bucket tells which names occur again in the corpus. Names are
hashes of what they stand for, so equal runs and pairs bear one name everywhere.

Each symbol carries its context: the stretch of words that decides how it was parsed. Where a context lies within equal
substrings, the symbols are equal. So a symbol that occurs once in the corpus proves every window around its context to be
unique; the next round parses only the stretches that windows still cover, and a window is left at last only if all its
high-level symbols, named by their whole context, are shared.

1. Rounds 1 to ROUNDS: runs and pairs as above.
2. The symbols left are named by their context; windows that hold no such symbol are named themselves. One more round.
3. Windows left are compared by 128-bit names of their words, two independent hashes; of equal ones the earliest place stays.
4. Words covered by a window that also starts earlier go.

Texts are tokenised once, into a table of chunks (a dictionary of the chunk's words and their sequence) that is bucketed by
chunk: what a round answers joins it in place, without moving it again. Names travel packed, one binary row per chunk and
bucket, so a passage that a third of all texts share arrives once per chunk, not once per text.

Defined results: a null or empty text has no words; rows with the same id are ordered by a hash of their text, equal rows
count as one document and get equal results; a null id comes last; an empty table gives no rows; other columns are ignored.
Ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm import textcore as T
from chronolith.llm.common import UNFORKED, Workspace, integral, partitions, ship

WINDOW, ROUNDS = 20, 2
#: Words of a symbol at most; a longer run or pair is not named. Words of a context that is used.
WIDEST, STRETCH = 7, 16
FAR = np.int32(1 << 30)
#: Bytes of text of a chunk, or one text.
CHUNK = 1 << 21
#: Chunks whose names meet in one bucket, and buckets at most.
TOGETHER, BUCKETS = 8, 1 << 16
#: Spark allows so many buckets of a table. Bytes of input, by Spark's estimate, that a task of a round has in hand; an input
#: partition is cut into so many buckets at most (UNKNOWN: where Spark has no estimate).
MOST = 100_000
IN_HAND, SPREAD, UNKNOWN = 4 << 20, 64, 4
#: Windows that are compared at a time, and rows of a bucket that are read at a time.
SLICE, ROWS = 1 << 18, 256
CHUNKS = "chunk long, rid binary, id binary, late binary, counts binary, dict binary, ends binary, seq binary"


def levels(h: np.ndarray) -> list[np.ndarray]:
    """Names of all stretches of 1, 2, 4, 8 and 16 words, by doubling."""
    out, size = [h], 1
    while size < 16:
        x = out[-1]
        out.append(T.pair(x[: max(0, len(x) - size)], x[size:], 300 + size))
        size *= 2
    return out


def stretch(lv: list[np.ndarray], at: np.ndarray, size: int) -> np.ndarray:
    """Names of the stretches of `size` words (below 32) from `at` on."""
    out, done = None, 0
    for k in range(4, -1, -1):
        if size >> k & 1:
            part = lv[k][at + done]
            out = part if out is None else T.pair(out, part, 400 + k)
            done += 1 << k
    return T.mix(out + T.U(size))


class Parse:
    """The symbols of a chunk after some rounds, of the stretches that live windows cover. h: word names; live: where windows
    start that may be repeated. Gaps between stretches are as the ends of texts: nothing inside a live window depends on them."""

    def __init__(self, h: np.ndarray, first: np.ndarray, live: np.ndarray):
        self.h, self.live, self.round = h, live, 0
        n = len(h)
        cover = np.zeros(n + WINDOW + 1, np.int32)
        s = np.flatnonzero(live)
        cover[s] += 1
        cover[s + WINDOW] -= 1
        self.words = np.flatnonzero(np.cumsum(cover[:n]) > 0).astype(np.int32)
        head = np.zeros(n + 1, bool)
        head[first[:-1]] = True
        self.name, self.start = h[self.words], self.words
        self.width = np.ones(len(self.words), np.int32)
        self.opens = head[self.words]
        self.opens[1:] |= self.words[1:] != self.words[:-1] + 1
        self.opens[:1] = True
        self.fresh = np.zeros(len(self.words), bool)
        self.left, self.right = self.start, self.start + np.int32(1)  # the context [left, right) of each symbol
        self.some = np.zeros(n + 2, np.int32)  # live windows before each word
        self.some[1 : n + 1] = np.cumsum(live)
        self.some[n + 1] = self.some[n]

    def _keep(self, keep: np.ndarray) -> None:
        at = np.flatnonzero(keep)
        for f in ("name", "start", "width", "left", "right", "opens", "fresh"):
            setattr(self, f, getattr(self, f)[at])

    def _within(self, lo: np.ndarray, hi: np.ndarray, most: int) -> np.ndarray:
        """Of contexts, those of at most so many words that lie within a live window."""
        ok = np.flatnonzero((lo >= 0) & (hi < FAR) & (hi - lo <= most))
        return ok[self.some[lo[ok] + 1] > self.some[np.maximum(hi[ok] - WINDOW, 0)]]

    def step(self) -> tuple[np.ndarray, np.ndarray]:
        """One round: (names of the new symbols, sorted, and which of them stand twice in this chunk)."""
        self.round += 1
        self.fresh[:] = False
        if self.round == 1:
            self._runs()
        self._pairs()
        new = np.flatnonzero(self.fresh)
        new = new[self._within(self.left[new], self.right[new], WINDOW)]
        self._asked = self.left[new], self.right[new], self.name[new]
        names, count = np.unique(self.name[new], return_counts=True)
        return names, count > 1

    def _runs(self) -> None:
        """Maximal runs of equal tokens. What ends a run, and that a single token is none, the tokens beside it decide;
        members of a run too long to be named are decided by the whole of it."""
        m = len(self.name)
        if not m:
            return
        begins = self.opens.copy()
        begins[1:] |= self.name[1:] != self.name[:-1]
        run0 = np.flatnonzero(begins)
        end = np.append(run0[1:], m)
        size = end - run0
        left = np.where(self.opens[run0], -FAR, self.start[run0] - np.int32(1))
        after = np.minimum(end, m - 1)
        right = np.where((end < m) & ~self.opens[after], self.start[after] + np.int32(1), FAR)
        take = (size > 1) & (size <= WIDEST)
        at = run0[take]
        self.name[at] = T.pair(self.name[at], size[take].astype(np.uint64), 101)
        self.width[at], self.fresh[at] = size[take], True
        self.left, self.right = np.repeat(left, size), np.repeat(right, size)
        self._keep(~(np.repeat(take, size) & ~begins))

    def _pairs(self) -> None:
        name, width, left, right, opens = self.name, self.width, self.left, self.right, self.opens
        m = len(name)
        if not m:
            return
        side = (T.mix(name + T.U(7919 * self.round)) & T.U(1)).astype(bool)
        joins = np.zeros(m, bool)
        joins[:-1] = ~side[:-1] & side[1:] & ~opens[1:] & (width[:-1] + width[1:] <= WIDEST)
        a = np.flatnonzero(joins)
        # An unjoined symbol is decided by the neighbour that it could have joined.
        alone = np.ones(m, bool)
        alone[a], alone[a + 1] = False, False
        nl, nr = left.copy(), right.copy()
        i = np.flatnonzero(alone & ~side)
        after = np.minimum(i + 1, m - 1)
        inside = (i + 1 < m) & ~opens[after]
        nr[i] = np.where(inside, np.maximum(right[i], right[after]), FAR)
        nl[i] = np.where(inside, np.minimum(left[i], left[after]), left[i])
        i = np.flatnonzero(alone & side)
        before = np.maximum(i - 1, 0)
        nl[i] = np.where(opens[i], -FAR, np.minimum(left[i], left[before]))
        nr[i] = np.where(opens[i], right[i], np.maximum(right[i], right[before]))
        nl[a], nr[a] = np.minimum(left[a], left[a + 1]), np.maximum(right[a], right[a + 1])
        name[a] = T.pair(name[a], name[a + 1], 201 + self.round)
        width[a] += width[a + 1]
        self.fresh[a] = True
        self.left, self.right = nl, nr
        keep = np.ones(m, bool)
        keep[a + 1] = False
        self._keep(keep)

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        """As step: names of the contexts of all symbols, and of live windows that hold none."""
        ok = self._within(self.left, self.right, STRETCH)
        lo, hi = self.left[ok], self.right[ok]
        fresh = np.ones(len(lo), bool)
        fresh[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        lo, hi = lo[fresh], hi[fresh]
        lv, place = self.named(self.h)
        name, size = np.zeros(len(lo), np.uint64), hi - lo
        for k in np.unique(size):
            name[size == k] = stretch(lv, place(lo[size == k]), int(k))
        held = np.zeros(len(self.h) + 1, np.int32)
        np.add.at(held, np.maximum(hi - WINDOW, 0), 1)
        np.add.at(held, lo + 1, -1)
        bare = np.flatnonzero(self.live & (np.cumsum(held[: len(self.h)]) == 0))
        self._asked = np.append(lo, bare), np.append(hi, bare + WINDOW), np.append(name, stretch(lv, place(bare), WINDOW))
        names, count = np.unique(self._asked[2], return_counts=True)
        return names, count > 1

    def named(self, h: np.ndarray):
        """Levels of names of the covered words, and where a place stands among them."""
        return levels(h[self.words]), lambda at: np.searchsorted(self.words, at)

    def left_of(self, names: np.ndarray, again: np.ndarray) -> np.ndarray:
        """The windows that stay live: not those around a context that doesn't occur again."""
        lo, hi, name = self._asked
        once = ~again[np.searchsorted(names, name)] if len(names) else np.zeros(0, bool)
        kill = np.zeros(len(self.h) + 2, np.int32)
        np.add.at(kill, np.maximum(hi[once].astype(np.int64) - WINDOW, 0), 1)
        np.add.at(kill, lo[once].astype(np.int64) + 1, -1)
        return self.live & (np.cumsum(kill[: len(self.h)]) == 0)


def parse(h: np.ndarray, first: np.ndarray, live: np.ndarray, rounds: int) -> tuple[Parse, np.ndarray, np.ndarray]:
    """The parse after so many rounds (ROUNDS + 1: the last naming), with the names that it sends."""
    p = Parse(h, first, live)
    for _ in range(min(rounds, ROUNDS)):
        names, again = p.step()
    if rounds > ROUNDS:
        names, again = p.top()
    return p, names, again


def all_windows(first: np.ndarray) -> np.ndarray:
    live = np.zeros(int(first[-1]), bool)
    live[window_starts(first)] = True
    return live


def window_starts(first: np.ndarray) -> np.ndarray:
    owner, rank = T.segments(np.maximum(np.diff(first) - WINDOW + 1, 0))
    return first[:-1][owner] + rank


def _rows(*fields: list, types: str) -> pa.RecordBatch:
    kinds = {"l": pa.int64(), "i": pa.int32(), "b": pa.binary(), "s": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(f, kinds[t]) for f, t in zip(fields, types, strict=True)], [f"c{i}" for i in range(len(fields))])


def _split(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket begins (buckets + 1)."""
    b = (key >> T.U(40)) % T.U(buckets)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


# --- the table of chunks


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash (Murmur3, seed 42) of long values, as its buckets use it."""
    x = x.view(np.uint64)
    h = np.full(len(x), 42, np.uint32)
    rot = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    for k in (x & T.U(0xFFFFFFFF), x >> T.U(32)):
        k = rot(k.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rot(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for r, c in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(r))) * np.uint32(c)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _cut(buckets: int, spread: int):
    def run(batches):
        """Texts to chunks. A chunk's number is one that Spark puts into one of the task's own buckets, which take turns; so a
        task writes `spread` files, and later steps have no more than one of them in hand."""
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        serial, ready, turn = np.int64(task) << np.int64(40), [[] for _ in range(spread)], 0
        for b in batches:
            data, off = T.column(b.column("text"))
            rid, late = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "late"))
            ident = b.column("id").fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in T.chunks(off, CHUNK):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                ws, we, h, first, g = T.words(d, o, T.BYTE, wide=True)
                _, lead, seq = np.unique(h, return_index=True, return_inverse=True)
                if (g[lead][seq] != g).any():
                    _, lead, seq = np.unique(np.column_stack([h, g]), axis=0, return_index=True, return_inverse=True)
                size = (we - ws)[lead]
                at = np.repeat(ws[lead] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                turn = (turn + 1) % spread
                while not ready[turn]:
                    some = serial + np.arange(max(4096, 8 * buckets))
                    serial += len(some)
                    home = spark_hash(some) % buckets
                    for k in range(spread):
                        ready[k] += some[home == (task * spread + k) % buckets].tolist()
                blobs = [rid[i:j], ident[i:j], late[i:j].astype(np.int8), np.diff(first).astype(np.uint32), d[at], np.cumsum(size).astype(np.uint32), seq.astype(np.uint16 if len(lead) <= 65536 else np.uint32)]
                yield _rows([ready[turn].pop(0)], *([T.blob(x)] for x in blobs), types="lbbbbbbb")

    return run


class Chunk:
    """A row of the table."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.rid, self.id, self.late = np.frombuffer(row["rid"], np.int64), np.frombuffer(row["id"], np.int64), np.frombuffer(row["late"], np.int8).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], np.uint32).astype(np.int64))])
        self.bytes = np.frombuffer(row["dict"], np.uint8)
        self.ends = np.frombuffer(row["ends"], np.uint32).astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.seq = np.frombuffer(row["seq"], np.uint16 if len(self.ends) <= 65536 else np.uint32)

    def names(self, key: int = 0) -> np.ndarray:
        return T.names(self.bytes, self.starts, self.ends, key)[self.seq] if len(self.ends) else np.zeros(0, np.uint64)


def _chunks(batches):
    for b in batches:
        for k in range(b.num_rows):
            yield Chunk({c: b.column(c)[k].as_py() for c in ("chunk", "rid", "id", "late", "counts", "dict", "ends", "seq")}), b.column("told")[k].as_py() if "told" in b.schema.names else None


# --- rounds


def _known(told, names: np.ndarray, again: np.ndarray, buckets: int) -> np.ndarray:
    """Which names occur again, here or, by what the buckets told, elsewhere."""
    again = again.copy()
    order, cut = _split(names, buckets)
    for t in told or ():
        if t["bucket"] >= 0:
            where = order[cut[t["bucket"]] : cut[t["bucket"] + 1]]
            again[where] |= np.unpackbits(np.frombuffer(t["bits"], np.uint8), count=len(where)).astype(bool)
    return again


def _left(chunk: Chunk, h: np.ndarray, told, rounds: int, buckets: int) -> tuple[Parse | None, np.ndarray]:
    """The windows that are live after so many rounds were told. Of these, the last one's answers and the windows that were
    live before it (bucket -1; all, if there is none) have been told."""
    live = all_windows(chunk.first)
    if not rounds:
        return None, live
    for t in told or ():
        if t["bucket"] < 0:
            live = np.unpackbits(np.frombuffer(t["bits"], np.uint8), count=len(live)).astype(bool)
    p, names, again = parse(h, chunk.first, live, rounds)
    return p, p.left_of(names, _known(told, names, again, buckets))


def _send(number: int, buckets: int):
    def run(batches):
        """Rows (bucket, kind, chunk, names): kind 0; and the windows that are live yet (kind 1)."""
        for chunk, told in _chunks(batches):
            h = chunk.names()
            _, live = _left(chunk, h, told, number - 1, buckets)
            _, names, _ = parse(h, chunk.first, live, number)
            order, cut = _split(names, buckets)
            low = names[order].view(np.uint8).reshape(-1, 8)[:, :5]
            used = np.flatnonzero(np.diff(cut)).tolist()
            blobs = [low[cut[k] : cut[k + 1]].tobytes() for k in used]
            if number > 1:
                used.append(chunk.number % buckets)
                blobs.append(T.blob(np.packbits(live)))
            yield _rows(used, [0] * (len(used) - (number > 1)) + [1] * (number > 1), [chunk.number] * len(used), blobs, types="iilb")

    return run


def _bucketwise(batches, work):
    """Calls work(columns of lists) once per value of the first column, in sorted input."""
    held: list[list] | None = None
    for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held is not None and held[0][0] != row[0]:
                yield from work(held)
                held = None
            if held is None:
                held = [[] for _ in row]
            for f, v in zip(held, row, strict=True):
                f.append(v)
    if held is not None:
        yield from work(held)


def _meet(batches):
    """Of each bucket, per chunk, which of the names that it sent came from another chunk too; live windows pass by."""

    def work(cols):
        bucket, kind, chunk, name = cols
        pass_by = [k for k in range(len(kind)) if kind[k]]
        if pass_by:
            yield _rows([chunk[k] for k in pass_by], [-1] * len(pass_by), [name[k] for k in pass_by], types="lib")
        rows = [k for k in range(len(kind)) if not kind[k]]
        if not rows:
            return
        raw = np.frombuffer(b"".join(name[k] for k in rows), np.uint8).reshape(-1, 5)
        x = np.zeros((len(raw), 8), np.uint8)
        x[:, :5] = raw
        x = x.view(np.uint64).ravel()
        order = np.argsort(x, kind="stable")
        y = x[order]
        same = y[1:] == y[:-1]
        hit = np.zeros(len(x), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        end = np.cumsum([len(name[k]) // 5 for k in rows])
        begin = np.concatenate([[0], end[:-1]])
        pick = [(k, hit[a:b]) for k, a, b in zip(rows, begin, end, strict=True) if hit[a:b].any()]
        yield _rows([chunk[k] for k, _ in pick], [bucket[0]] * len(pick), [T.blob(np.packbits(h)) for _, h in pick], types="lib")

    yield from _bucketwise(batches, work)


# --- windows


def _send_windows(buckets: int):
    def run(batches):
        """Names of windows (kind 2), each once a chunk, from its earliest place there; and the places where a window that
        stands earlier in its chunk starts again (kind 3)."""
        for chunk, told in _chunks(batches):
            h = chunk.names()
            p, live = _left(chunk, h, told, ROUNDS + 1, buckets)
            s = np.flatnonzero(live)
            if not len(s):
                continue
            (lv, place), (lw, _) = p.named(h), p.named(chunk.names(1))
            x, y = stretch(lv, place(s), WINDOW), stretch(lw, place(s), WINDOW)
            first, n = chunk.first, len(chunk.first) - 1
            rank = np.empty(n, np.int64)
            rank[np.lexsort((chunk.rid, chunk.id, chunk.late))] = np.arange(n)
            text = np.searchsorted(first, s, "right") - 1
            start = s - first[text]
            order = np.lexsort((s, rank[text], y, x))
            lead = np.ones(len(order), bool)
            lead[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
            top = order[lead][np.cumsum(lead) - 1]
            doc = lambda f: (f[text[order]] == f[text[top]])
            twin = doc(chunk.late) & doc(chunk.id) & doc(chunk.rid) & (start[order] == start[top])
            local = np.sort(s[order[~twin]])
            send = np.sort(order[lead])  # by place, so that a text's windows stand together
            o, cut = _split(x[send], buckets)
            out = ([], [], [], [], [])
            for k in np.flatnonzero(np.diff(cut)):
                q = send[o[cut[k] : cut[k + 1]]]
                used = np.unique(text[q])
                keys = np.column_stack([chunk.late[used], chunk.id[used], chunk.rid[used], first[used]])
                for f, v in zip(out, (2, int(k), chunk.number, T.blob(x[q]) + T.blob(y[q]), T.blob(keys) + T.blob(s[q].astype(np.uint32))), strict=True):
                    f.append(v)
            if len(local):
                for f, v in zip(out, (3, chunk.number % buckets, chunk.number, None, T.blob(local.astype(np.uint32))), strict=True):
                    f.append(v)
            yield _rows(*out, types="iilbb")

    return run


def _earliest(rows: list[tuple[int, bytes, bytes]], part: int, parts: int) -> pa.RecordBatch:
    """Of rows (chunk, names, places) of a bucket, (chunk, starts of its windows that also start earlier). Equal windows have
    equal names, so one of several parts of the names can be taken by itself."""
    xs, ys, ss, owner, keys, base = [], [], [], [], [], 0
    for _, n, p in rows:
        m = len(n) // 16
        x = np.frombuffer(n, np.uint64, m)
        at = np.flatnonzero((x >> T.U(8)) % T.U(parts) == part) if parts > 1 else slice(None)
        k = np.frombuffer(p, np.int64, (len(p) - 4 * m) // 8).reshape(-1, 4)
        s = np.frombuffer(p, np.uint32, m, len(p) - 4 * m)[at].astype(np.int64)
        xs.append(x[at])
        ys.append(np.frombuffer(n, np.uint64, m, 8 * m)[at])
        ss.append(s)
        used, of = np.unique(np.searchsorted(k[:, 3], s, "right") - 1, return_inverse=True)
        owner.append(base + of)
        keys.append(k[used])
        base += len(used)
    x, y, s, of, key = (np.concatenate(f) for f in (xs, ys, ss, owner, keys))
    start = s - key[of, 3]
    by = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[by][1:, :3] != key[by][:-1, :3]).any(1)
    rank = np.empty(len(key), np.int64)
    rank[by] = np.cumsum(fresh)
    r = rank[of]
    order = np.lexsort((start, r, y, x))
    lead = np.ones(len(order), bool)
    lead[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    top = order[lead][np.cumsum(lead) - 1]
    late = np.zeros(len(x), bool)
    late[order] = (r[order] != r[top]) | (start[order] != start[top])
    end = np.cumsum([len(f) for f in ss])
    begin = np.concatenate([[0], end[:-1]])
    pick = [k for k in range(len(rows)) if late[begin[k] : end[k]].any()]
    return _rows([rows[k][0] for k in pick], [T.blob(ss[k][late[begin[k] : end[k]]].astype(np.uint32)) for k in pick], types="lb")


def _match_windows(batches):
    """Of each bucket, (chunk, starts of its windows that also start earlier); places settled in their chunk pass by."""

    def work(cols):
        _, kind, chunk, name, place = cols
        if settled := [k for k in range(len(kind)) if kind[k] == 3]:
            yield _rows([chunk[k] for k in settled], [place[k] for k in settled], types="lb")
        rows = [k for k in range(len(kind)) if kind[k] == 2]
        if not rows:
            return
        parts = 1 + sum(len(name[k]) for k in rows) // 16 // SLICE
        for part in range(parts):
            yield _earliest([(chunk[k], name[k], place[k]) for k in rows], part, parts)

    yield from _bucketwise(batches, work)


def _remove(batches):
    for chunk, told in _chunks(batches):
        n = len(chunk.seq)
        cover = np.zeros(n + WINDOW + 1, np.int64)
        for blob in told or ():
            s = np.frombuffer(blob, np.uint32)
            np.add.at(cover, s, 1)
            np.add.at(cover, s + WINDOW, -1)
        stay = np.cumsum(cover)[:n] == 0
        size = (chunk.ends - chunk.starts)[chunk.seq] if n else np.zeros(0, np.int64)
        kept = np.flatnonzero(stay)
        # Kept words, each with a blank behind; a text's last blank is left off.
        long = size[kept] + 1
        at = np.cumsum(long)
        flat = np.full(int(long.sum()), 32, np.uint8)
        begin = at - long
        source = np.repeat(chunk.starts[chunk.seq[kept]] - (np.cumsum(size[kept]) - size[kept]), size[kept]) + np.arange(int(size[kept].sum()))
        flat[np.repeat(begin - (np.cumsum(size[kept]) - size[kept]), size[kept]) + np.arange(len(source))] = chunk.bytes[source]
        edge = np.searchsorted(kept, chunk.first)
        ends = np.concatenate([[0], at])[edge]
        words, left = np.diff(chunk.first), np.diff(edge)
        raw = flat.tobytes()
        texts = [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.id, mask=chunk.late.astype(bool)), pa.array(words), pa.array(words - left), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t.decode() for t in texts], pa.string())],
            ["id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def _spread(size: int) -> int:
    """Buckets of an input partition of so many bytes."""
    return UNKNOWN if size >= 1 << 40 else max(1, min(SPREAD, -(-size // IN_HAND)))


def dedup_substrings(docs: DataFrame, id_col: str, text_col: str, ws: Workspace, keep_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row, and, with keep_text, the kept words joined by blanks."""
    spark = docs.sparkSession
    ship(spark)
    integral(docs, id_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = base.select(F.xxhash64(F.lit(17), "id", F.coalesce("text", F.lit(""))).alias("rid"), "id", F.col("id").isNull().cast("long").alias("late"), "text")
    tasks = max(1, base._jdf.queryExecution().toRdd().getNumPartitions())
    spread = _spread(int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // tasks)
    n = min(MOST, tasks * spread)
    chunks = ws.bucketed(base.mapInArrow(_cut(n, spread), CHUNKS), "chunks", n, "chunk")
    buckets = max(2 * partitions(spark), min(BUCKETS, chunks.count() // TOGETHER))

    def beside(rows: DataFrame, what) -> DataFrame:
        """The chunks with what was told to them; only that moves."""
        return chunks.join(rows.repartition(n, "chunk").groupBy("chunk").agg(F.collect_list(what).alias("told")).hint("shuffle_hash"), "chunk", "left")

    rows, answer = chunks, F.struct("bucket", "bits")
    for number in range(1, ROUNDS + 2):
        sent = rows.mapInArrow(_send(number, buckets), "bucket int, kind int, chunk long, name binary").repartition("bucket").sortWithinPartitions("bucket")
        rows = beside(ws.save(sent.mapInArrow(_meet, "chunk long, bucket int, bits binary"), f"round-{number}"), answer)
    names = rows.mapInArrow(_send_windows(buckets), "kind int, bucket int, chunk long, x binary, y binary").select("bucket", "kind", "chunk", "x", "y")
    later = ws.save(names.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_match_windows, "chunk long, starts binary"), "later")
    got = beside(later, F.col("starts")).mapInArrow(_remove, "id long, n_words long, n_removed long, kept_sha256 string, kept string").coalesce(tasks)
    return (got if keep_text else got.drop("kept")).withColumnRenamed("id", id_col)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "substrings", UNFORKED)
    got = ws.save(dedup_substrings(docs, "doc_id", "text", ws, keep_text=False), "result")
    return got.coalesce(max(1, got.rdd.getNumPartitions() // TOGETHER))  # small rows: few files for whoever writes them


QUERIES = {"op4_substring_dedup": op4}
SQL: dict[str, str] = {}
