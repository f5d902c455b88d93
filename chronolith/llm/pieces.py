"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here (no generated code) and rebuilt as a `tokenizers` pipeline: normaliser (a compiled
character map, if the model has one, the dummy prefix and the metaspace marker), scores (unigram scores, or merge ranks of
a BPE model), byte fallback and decoder. All ids are this pipeline's. Where no piece holds the marker after another
character, a text splits before each run of markers without changing its ids; each distinct unit is then encoded once per
task, many to a text, in multithreaded batches. Other models encode whole texts.

Parity: the sentencepiece library encodes the same units (or texts); a text whose ids it gives differently (long runs of
markers, where equal scores tie) keeps its ids and says parity = false. Round trip: each text's own ids are turned back into
bytes and compared with the text; a text put together from remembered units that does not come back is encoded anew.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows give equal rows; an empty
table gives no rows; a null id is kept; other columns are kept, and a new column whose name is taken gets a "_" behind.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm import textcore as T
from chronolith.llm.common import free, ship

MODEL = os.environ.get("CHRONOLITH_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
THREADS = 2
#: Units that a task remembers, in two generations of at most CACHE (some 250 bytes each): a full one takes the place of the
#: older, which is dropped but for what is asked again. Longer units are encoded anew each time. Units and texts go to the
#: library BATCH units or CHUNK bytes at a time.
CACHE, LONG, BATCH = 100_000, 64, 4096
CHUNK = 1 << 20
#: Words remembered by their 128-bit name, some 50 bytes each.
REMEMBERED = 1_000_000
#: Words that go to the libraries as one text.
JOINED = 64
BLANK = np.arange(256) == 32
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, i


def fields(b: bytes):
    """(number, value) of a protobuf message: integers, or bytes of the other wire types."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        wire = key & 7
        if wire == 0:
            value, i = _varint(b, i)
        else:
            if wire == 2:
                n, i = _varint(b, i)
            elif wire in (1, 5):
                n = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire}")
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def parse(model: bytes) -> dict:
    """What of a model matters to encoding and decoding."""
    out = {"pieces": [], "type": 1, "byte_fallback": False, "unk": 0, "charsmap": b"", "prefix": True, "squeeze": True, "escape": True}
    for number, value in fields(model):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out["pieces"].append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    out["type"] = v
                elif n == 35:
                    out["byte_fallback"] = bool(v)
                elif n == 40:
                    out["unk"] = v
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    out["charsmap"] = v
                elif n == 3:
                    out["prefix"] = bool(v)
                elif n == 4:
                    out["squeeze"] = bool(v)
                elif n == 5:
                    out["escape"] = bool(v)
    return out


def rebuild(model: bytes) -> tuple[str, bool]:
    """The tokenizers pipeline as JSON, and whether texts may be split before markers."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    m = parse(model)
    if not m["escape"] or m["type"] not in (1, 2):
        raise ValueError("only unigram and BPE models with escaped white space are supported")
    pieces = m["pieces"]
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    if m["type"] == 1:
        low = min((s for _, s, k in pieces if k in (NORMAL, USER)), default=0.0)
        core = models.Unigram([(p, s if k in (NORMAL, USER) else low - 100.0) for p, s, k in pieces], unk_id=unk, byte_fallback=m["byte_fallback"])
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
        usable = {p: s for p, s, k in pieces if k in (NORMAL, USER)}
        merges = [(-s, len(p[:c]), p[:c], p[c:]) for p, s in usable.items() for c in range(1, len(p)) if p[:c] in usable and p[c:] in usable]
        merges.sort(key=lambda x: (x[0], vocab[x[2]], vocab[x[3]]))
        core = models.BPE(vocab, [(a, b) for _, _, a, b in merges], unk_token=pieces[unk][0], fuse_unk=True, byte_fallback=m["byte_fallback"])
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(re_("[ ]{2,}"), " ")]
    if m["prefix"]:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    ends = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence([*ends, decoders.Strip(" ", 1, 0)] if m["prefix"] else ends)
    if user := [AddedToken(p, normalized=False) for p, _, k in pieces if k == USER]:
        t.add_tokens(user)
    splits = m["prefix"] and not m["squeeze"] and not m["charsmap"] and not user and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in pieces)
    return t.to_str(), splits


def re_(pattern: str):
    from tokenizers import Regex

    return Regex(pattern)


class Codec:
    """Encodes and decodes batches, and tells where the sentencepiece library's ids differ."""

    def __init__(self, built: str, splits: bool, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece
        from tokenizers import Tokenizer

        self.t, self.splits = Tokenizer.from_str(built), splits
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unit = re.compile(f"{MARK}+[^{MARK}]*")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: set[str] = set()
        m = parse(model)
        self.prefix = m["prefix"]
        self.starts = np.array([p.startswith(MARK) for p, _, _ in m["pieces"]])
        raw = [bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in m["pieces"]]
        self.piece_size = np.array([len(x) for x in raw], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._forget()

    def _fill(self, missing: list[str], into: dict) -> None:
        for k in range(0, len(missing), BATCH):
            self._add(missing[k : k + BATCH], into)

    def _add(self, missing: list[str], into: dict) -> None:
        plain = [u[1:].replace(MARK, " ") for u in missing]
        got = self.t.encode_batch_fast(plain, add_special_tokens=False)
        for u, e, ref in zip(missing, got, self.sp.encode(plain, num_threads=1), strict=True):
            # A marker alone is what an empty text has no place for.
            ids = e.ids if u != MARK else [self.t.token_to_id(MARK)]
            if u != MARK and ids != ref:
                self.odd.add(u)
            into[u] = np.array(ids, np.int32).tobytes()

    def encode(self, texts: list[str]) -> tuple[list, list[bool]]:
        """Ids of each text, and whether all of its units agree with the sentencepiece library."""
        if not self.splits:
            got = [e.ids if t else [] for e, t in zip(self.t.encode_batch_fast(texts, add_special_tokens=False), texts, strict=True)]
            return got, [a == b for a, b in zip(got, self.sp.encode(texts, num_threads=1), strict=True)]
        units = [self.unit.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.old, self.known = self.known, {}
            self.odd.intersection_update(self.old)
        local: dict[str, bytes] = {}
        missing = set(itertools.chain.from_iterable(units)) - self.known.keys()
        again = missing & self.old.keys()
        self.known.update((u, self.old[u]) for u in again)
        missing -= again
        self._fill([u for u in missing if len(u) <= LONG], self.known)
        self._fill([u for u in missing if len(u) > LONG], local)
        of = self.known if not local else {**self.known, **local}
        ids = [np.frombuffer(b"".join(map(of.__getitem__, us)), np.int32) for us in units]
        same = [self.odd.isdisjoint(us) for us in units] if self.odd else [True] * len(units)
        return ids, same

    def encode_chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, counts, parity, round trip, decoded bytes) of UTF-8 texts. Where single blanks part a text, its
        units are its words, known by name and looked up together; other texts go the way of `encode`."""
        n = len(off) - 1
        slow = np.zeros(n, bool)
        blank = data == 32
        where = np.flatnonzero(blank[:-1] & blank[1:]) if len(data) else np.zeros(0, np.int64)
        if len(data) > 2:
            where = np.append(where, np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)))
        slow[np.searchsorted(off, where, "right") - 1] = True
        some = np.diff(off) > 0
        slow[some] |= blank[off[:-1][some]] | blank[off[1:][some] - 1]
        if not self.splits:
            slow[:] = True
        start, end, h, first, g = T.words(data[:0], off * 0, T.BYTE, BLANK, True) if slow.all() else T.words(data, off, T.BYTE, BLANK, True)
        u, lead, inverse = np.unique(h, return_index=True, return_inverse=True)
        second = g[lead]
        # Words that share one name but not the other go with their texts.
        slow[np.searchsorted(first, np.flatnonzero(second[inverse] != g), "right") - 1] = True
        at = np.minimum(np.searchsorted(self.keys, u), max(0, len(self.keys) - 1))
        known = self.keys[at] == u if len(self.keys) else np.zeros(len(u), bool)
        new = np.flatnonzero(~known)
        raw = data.tobytes() if len(new) or slow.any() else b""
        for k in range(0, len(new), BATCH):
            part = new[k : k + BATCH]
            plain = [raw[a:b].decode() for a, b in zip(start[lead[part]].tolist(), end[lead[part]].tolist(), strict=True)]
            self._keep.append((u[part], second[part], *self._learn(plain)))
        if len(new):
            old = (self.keys, self.second, self.size, self.flat, self.good)
            keys, twin, size, flat, good = (np.concatenate(x) for x in zip(old, *self._keep, strict=True))
            self._keep = []
            order = np.argsort(keys, kind="stable")
            begin = (np.cumsum(size) - size)[order]
            size = size[order]
            self.flat = flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(flat))]
            self.keys, self.second, self.size, self.good = keys[order], twin[order], size, good[order]
            at = np.searchsorted(self.keys, u)
        of = at[inverse]
        if len(of):
            slow[np.searchsorted(first, np.flatnonzero(self.second[of] != g), "right") - 1] = True
        size = self.size[of] if len(of) else np.zeros(0, np.int64)
        begin = (np.cumsum(self.size) - self.size)[of] if len(of) else size
        ids = self.flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] if len(of) else np.zeros(0, np.int32)
        run = lambda x: np.concatenate([[0], np.cumsum(x)])
        total = run(size)[first]
        same = np.diff(run(~self.good[of])[first]) == 0 if len(of) else np.ones(n, bool)
        ids, counts, same = self._whole(ids, total, same, np.flatnonzero(slow), raw, off)
        back, out = self._back(ids, counts, data, off)
        if not (fine := back | slow).all():  # what was put together wrongly
            ids, counts, same = self._whole(ids, run(counts), same, np.flatnonzero(~fine), data.tobytes(), off)
            back, out = self._back(ids, counts, data, off)
        if len(self.keys) > REMEMBERED:
            self._forget()
        return ids, counts, same, back, out

    def _whole(self, ids: np.ndarray, total: np.ndarray, same: np.ndarray, which: np.ndarray, raw: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids[total[i]:total[i+1]] of texts, those of some encoded anew."""
        counts = np.diff(total)
        if not len(which):
            return ids, counts, same
        got, agree = self.encode([raw[off[k] : off[k + 1]].decode() for k in which])
        parts, at = [], 0
        for k, x in zip(which, got, strict=True):
            parts += [ids[total[at] : total[k]], np.asarray(x, np.int32)]
            counts[k] = len(x)
            at = k + 1
        same[which] = agree
        return np.concatenate([*parts, ids[total[at] :]]), counts, same

    def bytes_of(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many texts' ids, and where each text's begin (n + 1)."""
        size = self.piece_size[ids]
        at = np.repeat(self.piece_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out = self.piece_bytes[at]
        off = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        if self.prefix:
            lead = off[:-1][(np.diff(off) > 0)]
            lead = lead[out[lead] == 32]
            gone = np.zeros(len(out) + 1, np.int64)
            gone[lead + 1] = 1
            keep = np.ones(len(out), bool)
            keep[lead] = False
            out, off = out[keep], off - np.cumsum(gone)[off]
        return out, off

    def _back(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list]:
        """Whether each text's ids are its bytes, and where the decoded bytes lie."""
        out, at = self.bytes_of(ids, counts)
        fit = np.diff(at) == np.diff(off)
        if fit.all():
            wrong = np.concatenate([[0], np.cumsum(out != data)])
            return np.diff(wrong[off]) == 0, [out, at]
        return np.array([f and np.array_equal(out[a:b], data[c:d]) for f, a, b, c, d in zip(fit, at, at[1:], off, off[1:], strict=False)]), [out, at]

    def _learn(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, ids, parity) of words. JOINED of them make one text for the libraries, whose ids part where a piece begins
        with the marker; where anything of such a text disagrees, its words go one by one."""
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        texts = [" ".join(g) for g in groups]
        got = [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        size, flat, good = [], [], []
        for g, x, r in zip(groups, got, self.sp.encode(texts, num_threads=1), strict=True):
            ids = np.array(x, np.int32)
            cut = np.flatnonzero(self.starts[ids])
            if x == r and len(cut) == len(g) and cut[0] == 0:
                size.append(np.diff(np.append(cut, len(ids))))
                flat.append(ids)
                good.append(np.ones(len(g), bool))
                continue
            mine = [e.ids for e in self.t.encode_batch_fast(g, add_special_tokens=False)]
            size.append(np.array([len(y) for y in mine], np.int64))
            flat.append(np.fromiter(itertools.chain.from_iterable(mine), np.int32))
            good.append(np.array([y == z for y, z in zip(mine, self.sp.encode(g, num_threads=1), strict=True)]))
        return np.concatenate(size), np.concatenate(flat), np.concatenate(good)

    def _forget(self) -> None:
        z = np.zeros(0, np.int64)
        self.keys, self.second, self.size, self.flat, self.good = z.astype(np.uint64), z.astype(np.uint64), z, z.astype(np.int32), z.astype(bool)
        self._keep: list = []

    def decode(self, ids: list) -> list[str]:
        return self.t.decode_batch([x.tolist() if isinstance(x, np.ndarray) else x for x in ids], skip_special_tokens=False)


def _loader(df: DataFrame, path: str):
    with open(path, "rb") as f:
        model = f.read()
    built, splits = rebuild(model)
    b = df.sparkSession.sparkContext.broadcast((built, splits, model))  # as large as the vocabulary, whatever the input
    return lambda: Codec(*b.value)


def encode(df: DataFrame, text_col: str, path: str = MODEL, digest: bool = False) -> DataFrame:
    """All columns, with ids array<int>, n_tokens, parity, round_trip (the ids, decoded, are the text) and, with digest,
    decoded_sha256 of the bytes that the ids decode to."""
    ship(df.sparkSession)
    load = _loader(df, path)
    kinds = {"ids": "array<int>", "n_tokens": "long", "parity": "boolean", "round_trip": "boolean"} | ({"decoded_sha256": "string"} if digest else {})
    new = [free(df.columns, k) for k in kinds]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{k}` {t}" for k, t in zip(new, kinds.values(), strict=True)])

    def run(batches):
        codec = load()
        for b in batches:
            data, off = T.column(b.column(text_col))
            for i, j in T.chunks(off, CHUNK):
                flat, counts, same, back, (out, at) = codec.encode_chunk(data[off[i] : off[j]], off[i : j + 1] - off[i])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
                more = [pa.array([hashlib.sha256(out[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())] if digest else []
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), lists, pa.array(counts), pa.array(same), pa.array(back), *more], [*b.schema.names, *new])

    return df.mapInArrow(run, ddl)


def decode(df: DataFrame, ids_col: str, path: str = MODEL, name: str = "text") -> DataFrame:
    """All columns, with the text decoded from a column of ids; null ids give the empty text."""
    ship(df.sparkSession)
    load = _loader(df, path)
    new = free(df.columns, name)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{new}` string"

    def run(batches):
        codec = load()
        for b in batches:
            out = codec.decode([x or [] for x in b.column(ids_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, new])

    return df.mapInArrow(run, ddl)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = encode(docs, "text", digest=True).drop("text")
    return rows.select("doc_id", "n_tokens", "ids", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), "decoded_sha256", "parity", "round_trip")


QUERIES = {"op9_sentencepiece": op9}
SQL: dict[str, str] = {}
