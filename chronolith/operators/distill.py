"""Greedy threshold clustering of embeddings in log order into facts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, LEAST, MOST = 0.8, 3, 64
SCHEMA = "grp string, run int, cluster int, n long, confidence double, first_lsn long, lsns array<long>"


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    edge = 1 - 1e-5
    fit = lambda x: x * np.minimum(1, edge / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12))
    p, q = fit(a), fit(b)
    gap = ((p - q) ** 2).sum(-1)
    return np.arccosh(np.maximum(1 + 2 * gap / ((1 - (p**2).sum(-1)) * (1 - (q**2).sum(-1))), 1))


def greedy(pdf: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Each row, in order of lsn, joins the nearest cluster (by hyperbolic distance to its Einstein centroid) within the
    threshold, or opens one; clusters of LEAST rows are facts with confidence n / (n + 2), MOST of them a run."""
    num: list[np.ndarray] = []
    den: list[float] = []
    lsns: list[list[int]] = []
    for lsn, hyp in pdf.sort_values("lsn")[["lsn", "hyp"]].itertuples(index=False):
        x = np.asarray(hyp, float)
        at = None
        if num:
            d = _dist(np.array(num) / np.array(den)[:, None], x)
            k = int(d.argmin())
            at = k if d[k] < threshold else None
        g = 1 / np.sqrt(max(1 - float((x**2).sum()), 1e-12))
        if at is None:
            num.append(g * x)
            den.append(g)
            lsns.append([int(lsn)])
        else:
            num[at] = num[at] + g * x
            den[at] += g
            lsns[at].append(int(lsn))
    facts = [x for x in lsns if len(x) >= LEAST]
    grp = pdf["grp"].iloc[0]
    return pd.DataFrame([(grp, i // MOST, i, len(x), len(x) / (len(x) + 2), x[0], x) for i, x in enumerate(facts)], columns=["grp", "run", "cluster", "n", "confidence", "first_lsn", "lsns"])


def distill(episodes: DataFrame, by: str = "agent_id", threshold: float = THRESHOLD) -> DataFrame:
    """The order within a group decides, so a group is one fold; groups run side by side."""
    run = lambda pdf: greedy(pdf, threshold)
    return episodes.where("embedding is not null").select(F.col(by).alias("grp"), "lsn", F.col("embedding.hyp").alias("hyp")).groupBy("grp").applyInPandas(run, SCHEMA)
