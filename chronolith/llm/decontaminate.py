"""Benchmark decontamination: BM25 over test items with block-max WAND, then a check of question and answer.

The inverted index holds the test items, cut into segments of SEGMENT words; every passage of a training text (PASSAGE
words, half overlapping) is a query. An impact is a BM25 term weight as a share of its segment's whole score, so one
threshold serves all segments, and all segments at or above it are retrieved:

1. Pivot: the longest terms of a segment are set aside until those left can't reach the threshold together. A passage
   that holds none of the terms set aside can't reach it and is skipped for that segment.
2. Block-max: segments stand in blocks of BLOCK; the greatest impact of each term in the block bounds all its segments.
3. Segments of blocks that survive are scored exactly.

A retrieved item is verified on the text: words in a row, five at a time, of its question (all but the last sentence) and
answer (the last one), wherever the text has them, as a passage may end between the two. It is a leak if both are found by
half, or the whole by four fifths.

The index is built for LIMIT items at a time, a bound on what the driver holds and a broadcast carries; more items are worked
off in blocks, which share the statistics (document frequencies, lengths) of all items, so blocks don't change a score.

Defined results: null or empty texts and items have no words and match nothing, nor does an item without an id; repeated rows
of texts give repeated rows, repeated items none; rows with a null id are judged too; empty tables give no rows (leaks) or all
rows (drop_leaks); other columns of texts are ignored (leaks) or kept (drop_leaks).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronolith.llm import textcore as T
from chronolith.llm.common import ship

SEGMENT, PASSAGE, BLOCK, SHINGLE = 40, 64, 4, 5
THRESHOLD, HALF, WHOLE = 0.6, 0.5, 0.8
K1, B = 1.2, 0.75
#: Items of one index at most.
LIMIT = 20_000


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, off = T.column(pa.array(texts, pa.string()))
    s, e, h, first = T.words(data, off, T.LOWER, T.NOT_ALNUM)
    return h, first, e - s


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct names of n words in a row; of fewer words, of all."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1]
    for j in range(1, n):
        out = T.pair(out, h[j : len(h) - n + 1 + j], j)
    return np.unique(out)


def parts(text: str) -> tuple[str, str]:
    """Question and answer: all but the last sentence or line, and that; a single sentence is a question alone."""
    cuts = [m.end() for m in re.finditer(r"[.!?]+\s+|\n+", text.rstrip())]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, "")


class Statistics:
    """Of all items: in how many segments each term stands, how many segments there are, and how long in all."""

    def __init__(self):
        self.terms, self.df, self.segments, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0

    def add(self, items: list) -> None:
        x = Postings(items)
        terms, inverse = np.unique(np.concatenate([self.terms, x.terms]), return_inverse=True)
        self.df = np.bincount(inverse, np.concatenate([self.df, x.df]), len(terms)).astype(np.int64)
        self.terms, self.segments, self.length = terms, self.segments + x.segments, self.length + int(x.length.sum())


class Postings:
    """(segment, term) with frequencies, as sorted keys (segment * terms + term)."""

    def __init__(self, items: list):
        h, first, self.size = _words([t for _, t in items])
        owner, rank = T.segments(np.diff(first))
        counts = np.maximum(1, -(-np.diff(first) // SEGMENT))
        base = np.concatenate([[0], np.cumsum(counts)])
        # Segments of one item are alike in length.
        seg = base[owner] + rank * counts[owner] // np.maximum(1, np.diff(first)[owner])
        self.item = np.repeat(np.arange(len(items)), counts)
        self.segments = int(base[-1])
        self.terms, self.at, term = np.unique(h, return_index=True, return_inverse=True)
        v = len(self.terms)
        self.keys, self.tf = np.unique(seg * v + term, return_counts=True)
        self.length = np.bincount(seg, minlength=self.segments)
        self.df = np.bincount(self.keys % max(1, v), minlength=v)


class Index:
    """Impacts of terms in segments, and their maxima in blocks, as sorted keys (owner * terms + term)."""

    def __init__(self, items: list, stats: Statistics | None = None):
        if stats is None:
            stats = Statistics()
            stats.add(items)
        x = Postings(items)
        self.ids = [i for i, _ in items]
        self.item, self.terms, n = x.item, x.terms, x.segments
        v = self.v = len(self.terms)
        kseg, kterm = x.keys // max(1, v), x.keys % max(1, v)
        df = stats.df[np.searchsorted(stats.terms, self.terms)]
        idf = np.log1p((stats.segments - df + 0.5) / (df + 0.5))
        mean = max(1.0, stats.length / max(1, stats.segments))
        weight = idf[kterm] * x.tf * (K1 + 1) / (x.tf + K1 * (1 - B + B * x.length[kseg] / mean))
        total = np.bincount(kseg, weight, n)
        self.keys, self.weight = x.keys, weight / total[kseg]
        block = kseg // BLOCK
        self.block_keys, inv = np.unique(block * v + kterm, return_inverse=True)
        self.block_weight = np.zeros(len(self.block_keys))
        np.maximum.at(self.block_weight, inv, self.weight)
        self.blocks, self.segments = -(-n // BLOCK), n
        # Long terms first; those from where the rest, with a margin for rounding, falls below the threshold are set aside.
        order = np.lexsort((kterm, -x.size[x.at][kterm], kseg))
        w, s = self.weight[order], kseg[order]
        before = np.cumsum(w) - w
        start = np.searchsorted(s, np.arange(n))
        before -= before[np.minimum(start, max(0, len(s) - 1))][s] if len(s) else 0
        must = order[1 - before >= THRESHOLD - 1e-9]
        pairs = np.unique(kterm[must] * max(1, self.blocks) + block[must])
        self.post_term, self.post_block = pairs // max(1, self.blocks), pairs % max(1, self.blocks)
        self.post_at = np.searchsorted(self.post_term, np.arange(v + 1))
        q, a = zip(*(parts(t) for _, t in items), strict=True) if items else ((), ())
        cut = lambda texts: [shingles(hh[f[i] : f[i + 1]]) for hh, f, _ in [_words(list(texts))] for i in range(len(texts))]
        self.question, self.answer = cut(q), cut(a)
        self.question_words, self.answer_words = (np.diff(_words(list(x))[1]) if items else np.zeros(0, int) for x in (q, a))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.terms >> T.U(44)).astype(np.int64)] = True

    @classmethod
    def of(cls, state: dict) -> Index:
        out = cls.__new__(cls)
        out.__dict__ = state
        return out

    def lookup(self, keys: np.ndarray, values: np.ndarray, ask: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
        return np.where(keys[at] == ask, values[at], 0.0)

    def retrieve(self, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], float]:
        """(text, item): best score of any passage, of all pairs at or above the threshold."""
        if not self.v or not len(h):
            return {}
        term = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.filter[(h >> T.U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), self.v - 1)
        hit = self.terms[at] == h[maybe]
        term[maybe[hit]] = at[hit]
        step = PASSAGE // 2
        counts = np.diff(first)
        windows = np.maximum(1, -(-counts // step) - 1)
        base = np.concatenate([[0], np.cumsum(windows)])
        pos = np.flatnonzero(term >= 0)
        n_post = self.post_at[term[pos] + 1] - self.post_at[term[pos]]
        pos, n_post = pos[n_post > 0], n_post[n_post > 0]
        if not len(pos):
            return {}
        who, nth = T.segments(n_post)
        block = self.post_block[self.post_at[term[pos]][who] + nth]
        text = np.searchsorted(first, pos, "right") - 1
        w = (pos - first[text]) // step
        w0 = (base[text] + np.minimum(w, windows[text] - 1))[who]
        w1 = (base[text] + np.clip(w - 1, 0, windows[text] - 1))[who]
        pairs = np.unique(np.concatenate([w0 * self.blocks + block, w1 * self.blocks + block]))
        win, block = pairs // self.blocks, pairs % self.blocks
        owner = np.searchsorted(base, win, "right") - 1
        start = first[owner] + (win - base[owner]) * step
        best: dict[tuple[int, int], float] = {}
        for lo in range(0, len(pairs), 4096):
            s, o, b = start[lo : lo + 4096], owner[lo : lo + 4096], block[lo : lo + 4096]
            at = s[:, None] + np.arange(PASSAGE)
            t = np.where(at < first[o + 1][:, None], term[np.minimum(at, len(term) - 1)], -1)
            t.sort(axis=1)
            t[:, 1:][t[:, 1:] == t[:, :-1]] = -1
            bound = np.where(t >= 0, self.lookup(self.block_keys, self.block_weight, b[:, None] * self.v + t), 0).sum(1)
            ok = np.flatnonzero(bound >= THRESHOLD - 1e-9)
            seg = b[ok][:, None] * BLOCK + np.arange(BLOCK)
            row = t[ok][:, None, :]
            score = np.where(row >= 0, self.lookup(self.keys, self.weight, seg[:, :, None] * self.v + row), 0).sum(2)
            score[seg >= self.segments] = 0
            for i, k in zip(*np.nonzero(score >= THRESHOLD - 1e-9), strict=True):
                key = (int(o[ok[i]]), int(self.item[seg[i, k]]))
                best[key] = max(best.get(key, 0.0), float(score[i, k]))
        return best

    def verify(self, h: np.ndarray, items: list[int]) -> list[tuple[int, float, float, bool]]:
        """(item, question's share, answer's share, leak) on one text's words."""
        have = shingles(h)
        runs: dict[int, np.ndarray] = {}
        out = []
        # A side of fewer words than a shingle is one run of its own length.
        side = lambda x, few: have if few >= SHINGLE or not len(x) else runs[few] if few in runs else runs.setdefault(few, shingles(h, few))
        for i in items:
            q, a = self.question[i], self.answer[i]
            found_q = int(np.isin(q, side(q, int(self.question_words[i]))).sum())
            found_a = int(np.isin(a, side(a, int(self.answer_words[i]))).sum())
            sq, sa = found_q / max(1, len(q)), found_a / len(a) if len(a) else 1.0
            out.append((i, sq, sa, (sq >= HALF and sa >= HALF) or found_q + found_a >= WHOLE * (len(q) + len(a))))
        return out

    def leaks(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        _, _, h, first = T.words(data, off, T.LOWER, T.NOT_ALNUM)
        best, out = self.retrieve(h, first), []
        by: dict[int, list[int]] = {}
        for t, i in sorted(best):
            by.setdefault(t, []).append(i)
        for t, items in by.items():
            out += [(t, i, best[t, i], q, a) for i, q, a, leak in self.verify(h[first[t] : first[t + 1]], items) if leak]
        return out


def indexes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """One index after the other, each of LIMIT items or so by hash of the id; the driver holds one at a time."""
    rows = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).distinct()
    blocks = -(-rows.count() // LIMIT)
    block = lambda k: sorted((r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect())
    if blocks == 1:
        yield Index(block(0))
        return
    stats = Statistics()
    for k in range(blocks):
        stats.add(block(k))
    for k in range(blocks):
        yield Index(block(k), stats)


def leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap) of every leak."""
    spark = docs.sparkSession
    ship(spark)
    out = None
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = items.schema[item_id].dataType
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, item_id {kind.simpleString()}, score double, question_overlap double, answer_overlap double"
    arrow = to_arrow_type(kind)
    for index in indexes(items, item_id, item_text):
        held = spark.sparkContext.broadcast(vars(index))  # at most about LIMIT items; plain arrays, so workers need no class

        def run(batches, held=held):
            x = Index.of(held.value)
            for b in batches:
                data, off = T.column(b.column("text"))
                rows = [(i + t, x.ids[k], s, q, a) for i, j in T.chunks(off) for t, k, s, q, a in x.leaks(data[off[i] : off[j]], off[i : j + 1] - off[i])]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], arrow), *(pa.array(c, pa.float64()) for c in cols[2:])], ["id", "item_id", "score", "question_overlap", "answer_overlap"])

        got = base.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, text_col: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """The rows without a leak, all columns as they are; no join and no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    for index in indexes(items, item_id, item_text):
        held = spark.sparkContext.broadcast(vars(index))

        def run(batches, held=held):
            x = Index.of(held.value)
            for b in batches:
                data, off = T.column(b.column(text_col))
                bad = {i + t for i, j in T.chunks(off) for t, *_ in x.leaks(data[off[i] : off[j]], off[i : j + 1] - off[i])}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks(docs, "doc_id", "text", items, "item_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {"op1_decontaminate": op1}
SQL: dict[str, str] = {}
