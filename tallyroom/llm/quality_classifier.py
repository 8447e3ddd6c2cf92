"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Features of a text: its distinct words, hashed, weighing together 1; and what its form is like (length, share of
capitals, digits, symbols and repeats ...), each statistic in one of several bins.  Pairs of features interact through
vectors of low rank; with (sum of v x)^2 - sum of (v x)^2 a text is scored in time linear in its features.  The model
is fitted in numpy on a bounded sample of labelled texts; scoring is one narrow pass.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm.common import bounded_labels, crc_remainder, field, longs, map_texts
from tallyroom.llm.common import without as without_columns

BUCKETS, BINS, RANK = 1 << 14, 16, 6
#: Labelled texts of each class that the model is fitted on, at most.
PER_CLASS = 2_500
_SYMBOLS = b"#*$%&|<>=+_~^\\{}"
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"


def statistics(body: bytes, words: list[bytes]) -> list[float]:
    """Numbers from 0 to 1 that describe a text's form."""
    n, chars = max(1, len(words)), max(1, len(body))
    counts = Counter(words)
    lines = [x for x in body.split(b"\n") if x.strip()]
    share = lambda these: (len(body) - len(body.translate(None, these))) / chars
    return [
        min(1.0, np.log2(len(words) + 1) / 16),
        min(1.0, chars / n / 20),
        share(_CAPITALS),
        share(_DIGITS) * 2,
        min(1.0, share(_SYMBOLS) * 4),
        min(1.0, share(b"!?") * 8),
        min(1.0, share(b".,;:") * 8),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(lines) / n * 4),
        min(1.0, share(b"|") * 16),
    ]


N_STATS = 12


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, values); a null or empty text has its statistics alone."""
    body = (text or "").encode("utf-8", "surrogatepass")
    words = body.lower().split()
    hashed = np.unique(np.fromiter(map(zlib.crc32, set(words)), np.int64) & (BUCKETS - 1))
    stats = np.asarray(statistics(body, body.split()))
    bins = BUCKETS + np.arange(N_STATS) * BINS + np.clip((np.sqrt(stats) * BINS).astype(np.int64), 0, BINS - 1)
    return np.concatenate([bins, hashed]), np.concatenate([np.full(N_STATS, 0.5), np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed))))])


class FactorisationMachine:
    """w0 + sum w x + sum over pairs (v_i . v_j) x_i x_j, logistic."""

    def __init__(self, size: int = BUCKETS + N_STATS * BINS, rank: int = RANK, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank))

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.v[index] * value[:, None]
        total = v.sum(0)
        return float(self.w0 + self.w[index] @ value + 0.5 * (total @ total - (v * v).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> FactorisationMachine:
        """Stochastic gradients with a step of its own for each parameter (squared gradients add up)."""
        if len(set(labels.tolist())) < 2:  # nothing to tell apart: the share of the class that there is
            self.w0 = 0.0 if not len(labels) else 3.0 if labels[0] else -3.0
            return self
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        weight = len(labels) / 2 / np.bincount(labels.astype(int), minlength=2)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                x, val = rows[i]
                v = self.v[x] * val[:, None]
                total = v.sum(0)
                raw = self.w0 + self.w[x] @ val + 0.5 * (total @ total - (v * v).sum())
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[i]) * weight[int(labels[i])]
                dw = error * val + decay * self.w[x]
                dv = error * (total[None, :] * val[:, None] - v * val[:, None]) + decay * self.v[x]
                g0 += error * error
                gw[x] += dw * dw
                gv[x] += dv * dv
                self.w0 -= rate * error / np.sqrt(g0)
                self.w[x] -= rate * dw / np.sqrt(gw[x])
                self.v[x] -= rate * 0.3 * dv / np.sqrt(gv[x])
        return self

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text)), -30, 30))))


def trained(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 3, left_out: int = 1, per_class: int = PER_CLASS) -> FactorisationMachine:
    """Fitted on at most ``per_class`` texts a class; only their features reach the driver."""
    sample = bounded_labels(docs, labels, label, key, text, modulus, left_out, per_class)

    def make() -> Callable[[list], list[tuple]]:
        return lambda texts: [(x.astype(np.int64), v) for x, v in map(features, texts)]

    rows = map_texts(sample, text, [longs("__x"), field("__v", "array<double>")], make, keep=[key, "__label"]).toPandas()
    rows = rows.sort_values(key, kind="stable")
    pairs = [(np.asarray(x), np.asarray(v)) for x, v in zip(rows["__x"], rows["__v"], strict=True)]
    return FactorisationMachine().fit(pairs, rows["__label"].to_numpy(dtype=float))


def classify_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None, modulus: int = 3, left_out: int = 1, per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """The columns (or ``keep``), then held_out, score (0 to 1, higher: label 1 likelier) and predicted (int).

    Learns from labelled ids whose crc32 modulo ``modulus`` is not ``left_out`` alone; labels that are null or not 0
    or 1, and null ids, are not learned from.  Null and empty texts are scored by their form.  A null id is not held
    out.  No labels: every score is 0.5.  Repeated rows give repeated rows; clashing columns are replaced.
    """
    model = trained(docs, labels, key=key, text=text, label=label, modulus=modulus, left_out=left_out, per_class=per_class)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: BUCKETS and RANK
    made = ["held_out", "score", "predicted"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]

    def make() -> Callable[[list], list[tuple]]:
        fitted = sent.value
        return lambda texts: [(fitted.score(t),) for t in texts]

    source = without_columns(docs, [n for n in made if n not in (key, text)])
    out = map_texts(source, text, [field("score", "double")], make, keep=[*dict.fromkeys([*kept, key])])
    out = out.withColumn("held_out", F.coalesce(crc_remainder(F.col(key), modulus) == left_out, F.lit(False)))
    return out.select(*[f"`{c}`" for c in kept], "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
