"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages. Each passage is encoded by hashed byte-trigram frequencies and a few shares (letters, case,
punctuation, repetition, word length); a trained layer embeds it; gated attention, learned from text labels alone, weighs
the embeddings, and a logistic unit scores the weighted sum. Training runs on a bounded sample of labelled texts; scoring
streams every whole text.

Defined results: a null or empty text is one empty passage and gets a score like any other; conflicting labels of one id
count as 0, null labels not at all; repeated rows get equal scores; an empty table gives no rows; without usable labels
every score is 1, so that nothing is rejected untrained; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm import textcore as T
from chronolith.llm.common import Workspace, ship

#: Words of a passage, hashed features, width of the embedding and of the attention.
PASSAGE, HASHED, WIDTH, GATE = 64, 128, 16, 8
STATS = 10
#: Bounds of training: labelled texts of each class, and passages in all, 138 two-byte numbers each (16 MB reach the driver).
#: Texts are taken whole, in the order of a hash of their id; one that no longer fits is left out.
SAMPLE, PASSAGES = 1200, 60_000
EPOCHS, BATCH, STEP, SEED = 40, 64, 0.01, 7
THRESHOLD = 0.3


def encode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of texts, and the first passage of each text (n + 1)."""
    start, end, h, first = T.words(data, off, T.BYTE)
    counts = np.diff(first)
    bags = np.maximum(1, -(-counts // PASSAGE))
    bag0 = np.concatenate([[0], np.cumsum(bags)])
    n = int(bag0[-1])
    out = np.zeros((n, HASHED + STATS), np.float32)
    if not len(start):
        return out, bag0
    owner, rank = T.segments(counts)
    p = bag0[owner] + rank // PASSAGE
    words = np.bincount(p, minlength=n).astype(np.float32)
    size = np.maximum(1, np.bincount(p, end - start, n))
    lower = data | 0x20
    alpha = ((lower >= 97) & (lower <= 122)) | (data >= 128)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    ink = ~T.SPACE[data]
    share = lambda mask: np.add.reduceat(np.append(mask, False).astype(np.int32), np.column_stack([start, end]).ravel())[::2]
    for k, mask in enumerate((alpha & ink, upper, digit, ink & ~alpha & ~digit)):
        out[:, HASHED + k] = np.bincount(p, share(mask), n) / size
    out[:, HASHED + 4] = size / np.maximum(1, words) / 10
    fresh = np.unique(T.pair(p.astype(np.uint64), h), return_index=True)[1]
    out[:, HASHED + 5] = np.bincount(p[fresh], minlength=n) / np.maximum(1, words)
    doc_fresh = np.unique(T.pair(owner.astype(np.uint64), h), return_index=True)[1]
    of_doc = np.bincount(owner[doc_fresh], minlength=len(counts)) / np.maximum(1, counts)
    out[:, HASHED + 6] = np.repeat(of_doc, bags)
    out[:, HASHED + 7] = words / PASSAGE
    out[:, HASHED + 8] = np.repeat(np.log1p(counts) / 10, bags)
    short = np.bincount(p, (end - start) <= 2, n)
    out[:, HASHED + 9] = short / np.maximum(1, words)
    # Trigrams of bytes, counted at their first byte's word; blanks between words, and what follows a text, count as one value.
    b = np.where(ink, data, 32).astype(np.uint32)
    last = off[1:][np.diff(off) > 0] - 1
    second, third = np.append(b[1:], np.uint32(32)), np.append(b[2:], np.full(2, 32, np.uint32))[: len(b)]
    second[last] = third[last] = third[np.maximum(last - 1, 0)] = 32
    g = b * np.uint32(961) + second * np.uint32(31) + third
    g = (g * np.uint32(2654435761)) >> np.uint32(32 - HASHED.bit_length() + 1)
    hist = np.bincount(np.repeat(p, end - start) * HASHED + g[np.flatnonzero(ink)], minlength=n * HASHED).reshape(n, HASHED)
    out[:, :HASHED] = np.sqrt(hist / size[:, None])
    out[words == 0] = 0  # as where no text has a word
    return out, bag0


class Model:
    """h = tanh(Ex + e); a = softmax(w . (tanh(Vh) * sigmoid(Uh))); score = sigmoid(c . sum(a h) + b)."""

    def __init__(self, mean, scale, weights: list[np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    @staticmethod
    def forward(x, bag, first, w):
        E, e, V, U, g, c, b = w
        h = np.tanh(x @ E + e)
        tv, su = np.tanh(h @ V), 1 / (1 + np.exp(-(h @ U)))
        s = (tv * su) @ g
        s = np.exp(s - np.maximum.reduceat(s, first)[bag])
        a = s / np.add.reduceat(s, first)[bag]
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        return h, tv, su, a, z, 1 / (1 + np.exp(-(z @ c + b[0])))

    def score(self, x: np.ndarray, bag0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of bags and the attention of their passages."""
        bag = np.repeat(np.arange(len(bag0) - 1), np.diff(bag0))
        r = self.forward((x - self.mean) / self.scale, bag, bag0[:-1], self.weights)
        return r[5].astype(np.float64), r[3]

    @classmethod
    def fit(cls, bags: list[np.ndarray], y: np.ndarray) -> Model:
        """Adam on the log loss with both classes weighing alike; deterministic."""
        rng = np.random.Generator(np.random.PCG64(SEED))
        flat = np.concatenate(bags)
        mean, scale = flat.mean(0), flat.std(0) + 1e-3
        bags = [((b - mean) / scale).astype(np.float32) for b in bags]
        d = flat.shape[1]
        w = [rng.normal(0, d**-0.5, (d, WIDTH)), np.zeros(WIDTH), rng.normal(0, 0.3, (WIDTH, GATE)), rng.normal(0, 0.3, (WIDTH, GATE)), rng.normal(0, 0.3, GATE), rng.normal(0, 0.3, WIDTH), np.zeros(1)]
        w = [x.astype(np.float32) for x in w]
        m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                x = np.concatenate([bags[i] for i in pick])
                counts = np.array([len(bags[i]) for i in pick])
                bag, first = np.repeat(np.arange(len(pick)), counts), np.cumsum(counts) - counts
                h, tv, su, a, z, p = cls.forward(x, bag, first, w)
                E, e, V, U, g, c, b = w
                dl = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                dz = dl[:, None] * c
                da = (h * dz[bag]).sum(1)
                ds = a * (da - np.add.reduceat(a * da, first)[bag])
                dt, du = ds[:, None] * g * su * (1 - tv**2), ds[:, None] * g * tv * su * (1 - su)
                dh = (a[:, None] * dz[bag] + dt @ V.T + du @ U.T) * (1 - h**2)
                grad = [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ du, (tv * su).T @ ds, z.T @ dl, np.array([dl.sum()])]
                step += 1
                for i, q in enumerate(grad):
                    q = q + 1e-4 * w[i]
                    m[i], v[i] = 0.9 * m[i] + 0.1 * q, 0.999 * v[i] + 0.001 * q * q
                    w[i] = (w[i] - STEP * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return cls(mean, scale, w)


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, ws: Workspace) -> Model | None:
    """Fits on at most SAMPLE labelled texts of each class, those with the smallest hashes of their id, all passages of each;
    held-out ids never. Of different texts with one id, that with the smallest hash is taken."""
    spark = docs.sparkSession
    ship(spark)
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    some = [one.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for c in (0, 1)]
    picked = ws.save(some[0].unionByName(some[1]), "sample")
    # 2 * SAMPLE ids at most: a proven bound.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def run(batches):
        for b in batches:
            data, off = T.column(b.column("text"))
            rows, size = [], []
            for i, j in T.chunks(off):
                x, bag0 = encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                size += np.diff(bag0).tolist()
                rows += [T.blob(x[a:z].astype(np.float16)) for a, z in zip(bag0[:-1], bag0[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y").cast(pa.int32()), b.column("key"), pa.array(size, pa.int64()), pa.array(rows, pa.binary())], ["id", "y", "key", "n", "x"])

    bags = texts.select("id", "y", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "id string, y int, key long, n long, x binary")
    bags = ws.save(bags.groupBy("id", "y").agg(F.min_by(F.struct("n", "x"), "key").alias("bag")).select("id", "y", "bag.n", "bag.x"), "bags")
    sizes = bags.select("id", "y", "n", F.xxhash64("id").alias("h")).collect()  # 2 * SAMPLE rows at most
    taken = []
    for c in (0, 1):
        left, mine = PASSAGES // 2, sorted((r for r in sizes if r.y == c), key=lambda r: (r.h, r.id))
        for r in mine:
            if r.n <= left:
                taken.append(r.id)
                left -= r.n
    got = bags.where(F.col("id").isin(taken)).collect()
    got.sort(key=lambda r: r.id)
    y = np.array([r.y for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    return Model.fit([np.frombuffer(r.x, np.float16).astype(np.float32).reshape(-1, HASHED + STATS) for r in got], y)


def _scorer(model: Model | None, text_col: str):
    parts = (model.mean, model.scale, model.weights) if model else None

    def run(batches):
        m = Model(*parts) if parts else None
        for b in batches:
            data, off = T.column(b.column(text_col))
            s = np.ones(b.num_rows)
            for i, j in T.chunks(off) if m else ():
                s[i:j] = m.score(*encode(data[off[i] : off[j]], off[i : j + 1] - off[i]))[0]
            yield b, s

    return run


def score(docs: DataFrame, id_col: str, text_col: str, model: Model | None) -> DataFrame:
    """(id, score, predicted) per row."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scorer = _scorer(model, "text")

    def run(batches):
        for b, s in scorer(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["id", "score", "predicted"])

    return base.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str, model: Model | None) -> DataFrame:
    """The rows that the model predicts as 1, all columns as they are."""
    ship(docs.sparkSession)
    scorer = _scorer(model, text_col)

    def run(batches):
        for b, s in scorer(batches):
            yield b.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, "doc_id", "text", "quality", Workspace(spark, "quality"))
    return score(docs, "doc_id", "text", model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES = {"op7_quality": op7}
SQL: dict[str, str] = {}
