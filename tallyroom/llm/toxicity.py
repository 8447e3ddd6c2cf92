"""Toxicity: a convolutional text classifier with hashed word embeddings, trained in numpy.

A word's embedding is the sum of the vectors of its hash and of the hashes of its first letters, so that inflected and
unseen forms share what they begin with.  Filters of several widths slide over the whole text; each filter's largest
value goes into a logistic output.  Scores do not see the language; thresholds on them are calibrated by language.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.llm.common import bounded_labels, broadcast_if, crc_remainder, known_labels, map_texts, without, written

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
#: Letters of a word's beginning that are hashed beside the word.
STARTS = (4, 5, 6)
#: Labelled texts of each class that the model is fitted on, at most, and their code points together; each is read whole.
PER_CLASS, PER_CLASS_CHARS = 1_200, 20_000_000
#: A word is learned from if so many sampled texts hold it; single steps of training, at least, and passes.
LEAST_TEXTS, STEPS, PASSES = 2, 6_000, 4
#: Steps of the scores by which labelled texts are counted for the thresholds.
BINS = 1_000
#: Code points of the texts whose words a task holds at the same time; a longer text is alone.
PART_CHARS = 500_000
#: Words whose filter values a task keeps; beyond, it begins anew.
WORDS_KEPT = 50_000
#: Labelled ids (8 bytes each) that may be sent to all executors; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def in_parts(texts: list[str | None], most: int = PART_CHARS) -> Iterator[list[str | None]]:
    """The texts in order, so many at a time as hold ``most`` code points together, one at least: their words are objects."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text or "") > most:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text or "")
    if part:
        yield part


def buckets(word: str) -> list[int]:
    """1 + len(STARTS) hash buckets; beginnings longer than the word stand for the word."""
    return [zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS, *[zlib.crc32(b"^%d" % n + word[:n].encode("utf-8", "surrogatepass")) % BUCKETS for n in STARTS]]


class TextCNN:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.conv = {k: rng.normal(0, 0.4, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS}
        self.bias = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.out, self.out_bias = rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32), -1.0

    def values(self, found: list[list[int]]) -> dict[int, np.ndarray]:
        """For each width, what each word adds at each place of a filter: (words, width, FILTERS)."""
        vectors = self.emb[np.asarray(found, np.int64).reshape(-1, 1 + len(STARTS))].sum(1)
        return {k: np.einsum("nd,kdf->nkf", vectors, self.conv[k]) for k in WIDTHS}

    def pooled(self, values: dict[int, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest value over a text of words ``at``, and where; 0 where the text is too short or nothing is positive."""
        top, where = np.zeros((len(WIDTHS), FILTERS), np.float32), np.full((len(WIDTHS), FILTERS), -1)
        for i, k in enumerate(WIDTHS):
            n = len(at) - k + 1
            if n < 1:
                continue
            total = values[k][:, 0][at[:n]]
            for j in range(1, k):
                total = total + values[k][:, j][at[j : j + n]]
            best = total.argmax(0)
            peak = total[best, np.arange(FILTERS)] + self.bias[k]
            top[i] = np.maximum(peak, 0)
            where[i] = np.where(peak > 0, best, -1)
        return top, where

    def fit(self, texts: list[list[str]], labels: np.ndarray, rate: float = 0.06, seed: int = 7, least_texts: int = LEAST_TEXTS) -> TextCNN:
        """Stochastic gradients, scaled by each parameter's past ones; the classes weigh the same.

        Words of fewer than ``least_texts`` texts are left out of training, as they would only be learned by heart; what
        they share with others, their beginnings, is learned from those.
        """
        if len(set(labels.tolist())) < 2:
            self.out[:] = 0
            self.out_bias = -3.0 if not len(labels) or not labels[0] else 3.0
            return self
        rng = np.random.default_rng(seed)
        held = Counter(w for t in texts for w in set(t))
        texts = [[w for w in t if held[w] >= least_texts] for t in texts]
        known: dict[str, int] = {}
        coded = [np.fromiter((known.setdefault(w, len(known)) for w in t), np.int64, len(t)) for t in texts]
        found = np.asarray([buckets(w) for w in known], np.int64).reshape(-1, 1 + len(STARTS))
        g_emb = np.full_like(self.emb, 1e-6)
        g_conv, g_bias, g_out, g_b = {k: np.full_like(c, 1e-6) for k, c in self.conv.items()}, {k: np.full_like(c, 1e-6) for k, c in self.bias.items()}, np.full_like(self.out, 1e-6), 1e-6
        weight = len(labels) / 2 / np.bincount(labels.astype(int), minlength=2)
        for epoch in range(max(PASSES, -(-STEPS // len(coded)))):
            step = rate / (1 + epoch)
            for i in rng.permutation(len(coded)):
                at = coded[i]
                some, local = np.unique(at, return_inverse=True)
                top, where = self.pooled(self.values(found[some]), local)
                flat = top.ravel()
                error = np.float32((1 / (1 + np.exp(-np.clip(flat @ self.out + self.out_bias, -30, 30))) - labels[i]) * weight[int(labels[i])])
                back = (error * self.out).reshape(top.shape)
                d_out = error * flat
                g_out += d_out * d_out
                self.out -= step * d_out / np.sqrt(g_out)
                g_b += error * error
                self.out_bias -= float(step * error / np.sqrt(g_b))
                for a, k in enumerate(WIDTHS):
                    live = np.flatnonzero(where[a] >= 0)
                    if not len(live):
                        continue
                    g_bias[k][live] += back[a, live] ** 2
                    self.bias[k][live] -= step * back[a, live] / np.sqrt(g_bias[k][live])
                    for j in range(k):
                        rows = found[at[where[a, live] + j]]
                        vectors = self.emb[rows].sum(1)
                        d_conv = vectors.T * back[a, live]
                        d_emb = (self.conv[k][j][:, live] * back[a, live]).T
                        g_conv[k][j][:, live] += d_conv**2
                        self.conv[k][j][:, live] -= step * d_conv / np.sqrt(g_conv[k][j][:, live])
                        for b in range(rows.shape[1]):
                            np.add.at(g_emb, rows[:, b], d_emb**2)
                            np.add.at(self.emb, rows[:, b], -step * d_emb / np.sqrt(g_emb[rows[:, b]]))
        return self

    def scorer(self) -> Callable[[list[str | None]], list[float]]:
        """Scores whole texts; a word's filter values are computed once and kept."""
        known: dict[str, int] = {}
        held: dict[int, np.ndarray] = {k: np.empty((0, k, FILTERS), np.float32) for k in WIDTHS}

        def score(texts: list[str | None]) -> list[float]:
            split = [words_of(t) for t in texts]
            if len(known) > WORDS_KEPT:
                known.clear()
                held.update({k: v[:0] for k, v in held.items()})
            new = [w for w in {w for ws in split for w in ws} if w not in known]
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                for k, v in self.values([buckets(w) for w in new]).items():
                    held[k] = np.concatenate([held[k], v])
            out = []
            for ws in split:
                top, _ = self.pooled(held, np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
                out.append(float(1 / (1 + np.exp(-np.clip(top.ravel() @ self.out + self.out_bias, -30, 30)))))
            return out

        return score


def calibrated(counts: list[tuple], least: int = 30) -> float | None:
    """The threshold with the best F1, from (bin, texts, texts of label 1) of a language; halfway between two bins that hold texts.

    None for fewer than ``least`` such texts, or one class alone.
    """
    at, n, y = (np.asarray(x, np.int64) for x in zip(*sorted(counts, reverse=True), strict=True))
    if n.sum() < least or y.sum() in (0, n.sum()):
        return None
    i = int((2 * np.cumsum(y) / (np.cumsum(n) + y.sum())).argmax())
    low = at[i + 1] + 1 if i + 1 < len(at) else 0
    return float(np.clip((at[i] + low) / 2 / BINS, 0.05, 0.95))


def trained(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 4, left_out: int = 2, per_class: int = PER_CLASS, per_class_chars: int = PER_CLASS_CHARS, least_texts: int = LEAST_TEXTS) -> tuple[TextCNN, list]:
    """The model and the ids that it is fitted on: of the sampled ones all but every fifth.

    At most 2 * per_class whole texts, one an id, of 2 * per_class_chars code points together, reach the driver.
    """
    sample = bounded_labels(docs, labels, label, key, text, modulus, left_out, per_class, per_class_chars).where(crc_remainder(F.col(key), 5) != 0)
    rows = sample.select(F.col(key).alias("id"), F.col(text).alias("body"), F.col("__label").alias("y")).toPandas().sort_values(["id", "body"], kind="stable")
    return TextCNN().fit([words_of(b) for b in rows["body"]], rows["y"].to_numpy(dtype=float), least_texts=least_texts), list(dict.fromkeys(rows["id"].tolist()))


def thresholds(docs: DataFrame, labels: DataFrame, fitted: list, scored: Callable[[DataFrame, list[str]], DataFrame], *, key: str, label: str, lang: str, modulus: int, left_out: int, least: int) -> DataFrame:
    """(__lang, lang_threshold): a written row for each language that has one, from all labelled texts but for held-out and fitted ids.

    scored: from texts and the columns to keep to those and their score.  Only labelled texts are scored for it, where
    they lie.  Rows are counted by id before labels are joined, so no id gathers its rows; a language is BINS + 1 rows at
    most, and languages stay in tasks, however many a dirty column holds.
    """
    ids = docs.sparkSession.createDataFrame([(i,) for i in fitted], T.StructType([T.StructField(key, docs.schema[key].dataType)]))
    # at most 2 * per_class ids: a proven bound for the broadcast
    known = written(known_labels(labels, label, key, modulus, left_out).join(F.broadcast(ids), key, "left_anti"))
    some = docs.where(F.col(lang).isNotNull()).join(broadcast_if(known.select(key), BROADCAST_ROWS), key, "left_semi")
    rows = scored(some, [key, lang]).select(key, F.col(lang).cast("string").alias("__lang"), F.floor(F.col("score") * BINS).alias("__bin"))
    rows = rows.groupBy(key, "__lang", "__bin").agg(F.count("*").alias("__n")).join(known, key)
    bins = rows.groupBy("__lang", "__bin").agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col("__label")).alias("y"))
    # languages that can't have a threshold are left out before their bins come together
    lines = bins.groupBy("__lang").agg(F.collect_list(F.struct("__bin", "n", "y")).alias("bins"), F.sum("n").alias("n"), F.sum("y").alias("y")).where((F.col("n") >= least) & (F.col("y") > 0) & (F.col("y") < F.col("n")))

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [calibrated([(r["__bin"], r["n"], r["y"]) for r in some], least) for some in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["__lang", "lang_threshold"])

    return written(lines.select("__lang", "bins").mapInArrow(level, "__lang string, lang_threshold double").where("lang_threshold IS NOT NULL"))


def classify_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str | None = "lang", keep: list[str] | None = None, modulus: int = 4, left_out: int = 2, per_class: int = PER_CLASS, per_class_chars: int = PER_CLASS_CHARS, least_texts: int = LEAST_TEXTS, threshold: float = 0.3, least: int = 30) -> DataFrame:
    """The columns (or ``keep``), then held_out, score, predicted (score >= threshold), lang_threshold and rejected.

    score: 0 to 1, higher: label 1 likelier; rejected: score >= the language's calibrated threshold (the default for
    a null or unknown language, and for one of fewer than ``least`` labelled texts that the model was not fitted on).
    per_class, per_class_chars: bounds of the sample that the model is fitted on, in texts and in code points;
    least_texts: how many of its texts hold a word that it is fitted on.  Learns from labelled ids whose crc32 modulo ``modulus`` is not ``left_out``
    alone; thresholds come from all such texts, of any length, whose ids the model was not fitted on, which are scored
    once more for it.  Null and empty texts score as texts of no words.  A null id is not held out.  No labels: no text
    is rejected.  Repeated rows give repeated rows; clashing columns are replaced.
    """
    model, fitted = trained(docs, labels, key=key, text=text, label=label, modulus=modulus, left_out=left_out, per_class=per_class, per_class_chars=per_class_chars, least_texts=least_texts)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: BUCKETS and DIM
    made = ["held_out", "score", "predicted", "lang_threshold", "rejected"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]

    def make() -> Callable[[list], list[tuple]]:
        score = sent.value.scorer()
        return lambda texts: [(s,) for part in in_parts(texts) for s in score(part)]

    source = without(docs, [n for n in made if n not in (key, text)])
    use = [lang] if lang and lang in docs.columns else []
    scored = lambda df, columns: map_texts(df, text, [T.StructField("score", T.DoubleType())], make, keep=columns)
    out = scored(source, [*dict.fromkeys([*kept, key, *use])])
    if use:
        levels = thresholds(source, labels, fitted, scored, key=key, label=label, lang=lang, modulus=modulus, left_out=left_out, least=least)
        out = out.join(broadcast_if(levels, BROADCAST_ROWS), F.col(lang).cast("string") == F.col("__lang"), "left").withColumn("lang_threshold", F.coalesce("lang_threshold", F.lit(threshold)))
    else:
        out = out.withColumn("lang_threshold", F.lit(threshold))
    out = out.withColumns({"held_out": F.coalesce(crc_remainder(F.col(key), modulus) == left_out, F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})
    return out.withColumn("rejected", F.col("score") >= F.col("lang_threshold")).select(*[f"`{c}`" for c in kept], *made)
