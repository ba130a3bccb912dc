"""Toxic passages by maximum-scoring segments over token log-odds.

Fit. A bounded sample of labelled rows outside the held-out fold (`sample` rows, least hash of doc_id first)
gives the classifier; rows that agree in two MinHash values of word triples, so nearly always copies, share a weight of one, so that
a copied text does not make its words look toxic, whatever their labels. Three quarters give, per hashed token, the documents of either class that hold
it; corpus counts over all documents are the Dirichlet prior. A token scores its log-odds if they are large and
its likelihood-ratio statistic significant, and minus `drift` otherwise.

Score. One linear pass over a text's tokens finds all maximal scoring segments: every toxic passage. For segments
of score S in n tokens the expected number by chance is K n exp(-lambda S) (extreme-value law); lambda solves
sum p exp(lambda s) = 1 over the corpus's token distribution and K is fitted to clean documents. A document's
evidence is the sum of lambda S - ln(K n) over significant segments. Below significance it is graded: by the surprise of
the best segment, and without any by the mean log-odds of the tokens, each below all evidence of the kind before. A
logistic curve, fitted on the last quarter of the sample, turns it into a probability.

What the driver holds is bounded: 2^bits token counts, three totals of clean texts, a histogram of evidence by label.
Defined cases. Null or empty text: no evidence, the score of a text without toxic passages. Repeated rows: each is
scored. Labels that disagree for a doc_id: the larger counts. Null labels are left out. If the last quarter of the sample
lacks a label value, the whole sample fits the curve. Empty tables or no usable label: every score is near 0.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Batches, checkpointed, rows_to_batch, slices, texts_of

FAINT = 0.05  #: evidence without a significant segment is below twice this, and so far from that of one, which is -ln(max_evalue) or more
_WORD_BYTES = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class ToxicityOptions:
    bits: int = 18
    sample: int = 50_000
    folds: int = 5
    prior_strength: float = 2.0  #: pseudo-documents of a token of average frequency
    min_log_odds: float = 1.0
    min_statistic: float = 25.0
    drift: float = 0.5
    max_evalue: float = 0.05


def tokens(text: str, bits: int) -> np.ndarray:
    """Bucket of each word: lower case, ASCII punctuation as space."""
    mask = (1 << bits) - 1
    words = text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & mask


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, left to right, in linear time.

    Only positive scores start or end one, so the walk is over these. A stack holds candidate segments with the
    cumulative score before and after each; a new one is joined with the nearest one that starts lower as long as it ends higher.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, before, after, link to the nearest lower start
    for i in positive.tolist():
        start, end, before, after = i, i + 1, float(total[i]), float(total[i + 1])
        link = len(stack) - 1
        while True:
            while link >= 0 and stack[link][2] >= before:
                link = stack[link][4]
            if link < 0 or stack[link][3] >= after:
                break
            start, before, nxt = stack[link][0], stack[link][2], stack[link][4]
            del stack[link:]
            link = nxt
        stack.append((start, end, before, after, link))
    return [(s, e, b - a) for s, e, a, b, _ in stack]


def _signature(text: str, salt: int) -> int:
    words = text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    return min((zlib.crc32(b" ".join(words[i : i + 3]), salt) for i in range(max(1, len(words) - 2))), default=0)


def sampled_labels(labels: DataFrame, options: ToxicityOptions) -> DataFrame:
    """At most `sample` (doc_id, toxic) rows outside the held-out fold."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return known.filter(F.crc32(F.col("doc_id").cast("string")) % options.folds != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(options.sample)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("first", pa.int64()), ("second", pa.int64())])


def _labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, text and the columns of marks for the documents of marks, which are at most `sample` rows of a few numbers."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(marks), "doc_id")


def training_documents(docs: DataFrame, labels: DataFrame, options: ToxicityOptions) -> DataFrame:
    """(doc_id, kind, part, weight) of the sample; kind is the label, part 0 to 3, the weights of near copies add up to 1. No text is shuffled."""

    def signed(batches: Batches) -> Batches:
        for b in slices(batches):
            texts = texts_of(b.column("text"))
            yield rows_to_batch(_SIGNED, [b.column("doc_id"), b.column("toxic"), [_signature(t, 1) for t in texts], [_signature(t, 2) for t in texts]])

    rows = checkpointed(_labelled(docs, sampled_labels(labels, options)).mapInArrow(signed, "doc_id long, toxic int, first long, second long"))
    copies = rows.groupBy("first", "second").agg(F.count("*").alias("copies"))
    once = rows.join(copies, ["first", "second"]).groupBy("doc_id").agg(F.max("toxic").alias("kind"), F.min(1 / F.col("copies")).alias("weight"))
    return once.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)))


_COUNTS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("n", pa.float64())])


def _counted(bits: int, kinds: int, by_document: bool):
    """Task: totals of buckets per kind (column kind, 0 where absent), rows by their weight (1 where absent); bucket -1 counts rows."""

    def run(batches: Batches) -> Batches:
        total, rows = np.zeros((kinds, 1 << bits)), np.zeros(kinds)
        for b in slices(batches):
            kind = b.column("kind").to_pylist() if "kind" in b.schema.names else [0] * b.num_rows
            weight = b.column("weight").to_pylist() if "weight" in b.schema.names else [1.0] * b.num_rows
            for t, k, w in zip(texts_of(b.column("text")), kind, weight, strict=True):
                own = tokens(t, bits)
                rows[k] += w
                if by_document:
                    total[k, np.unique(own)] += w
                else:
                    np.add.at(total[k], own, 1)
        for k in range(kinds):
            at = np.flatnonzero(total[k])
            yield rows_to_batch(_COUNTS, [np.concatenate(([-1], at)), np.full(len(at) + 1, k, np.int32), np.concatenate((rows[k : k + 1], total[k][at]))])

    return run


def _gathered(df: DataFrame, bits: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, 2^bits) totals and rows per kind; what comes to the driver is bounded by the buckets."""
    t = df.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    kind, bucket, n = (t.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    total, rows = np.zeros((kinds, 1 << bits)), np.zeros(kinds)
    rows[kind[bucket < 0]] = n[bucket < 0]
    total[kind[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    return total, rows


def token_scores(held: np.ndarray, rows: np.ndarray, corpus: np.ndarray, options: ToxicityOptions) -> tuple[np.ndarray, np.ndarray]:
    """Score of each bucket from documents of class 0 and 1 that hold it, with a Dirichlet prior in proportion to the corpus; and its plain log-odds."""
    prior = options.prior_strength * corpus / max(corpus.sum(), 1.0) * max(np.count_nonzero(corpus), 1)
    prior = np.clip(prior, 0.01, 50.0)
    share = (held + prior) / (rows[:, None] + 2 * prior + 1e-9)
    share = np.clip(share, 1e-9, 1 - 1e-9)
    odds = np.log(share[1] / (1 - share[1])) - np.log(share[0] / (1 - share[0]))
    both, n = held.sum(axis=0), max(rows.sum(), 1.0)
    expected = np.maximum(rows[:, None] * both / n, 1e-12)
    statistic = 2 * np.where(held > 0, held * np.log(np.maximum(held, 1e-12) / expected), 0).sum(axis=0)
    telling = (odds >= options.min_log_odds) & (statistic >= options.min_statistic)
    return np.where(telling, odds, -options.drift).astype(np.float32), np.clip(odds, -5, 5).astype(np.float32)


def solve_lambda(scores: np.ndarray, corpus: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; 1 where there is none."""
    p = corpus / max(corpus.sum(), 1.0)
    up = p[scores > 0]
    if not up.sum() or (p * scores).sum() >= 0:
        return 1.0
    value = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    low, high = 1e-6, 1e-3
    while value(high) < 0 and high < 100:
        low, high = high, 2 * high
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


@dataclass
class ToxicityModel:
    scores: np.ndarray
    odds: np.ndarray
    rate: float
    scale: float
    slope: float
    intercept: float
    options: ToxicityOptions

    def passages(self, text: str) -> tuple[list[tuple[int, int, float]], int, float]:
        """Segments, tokens, and the mean log-odds of the tokens."""
        own = tokens(text, self.options.bits)
        return maximal_segments(self.scores[own]), len(own), float(self.odds[own].mean()) if len(own) else 0.0

    def surprise(self, segments: list[float], n: int, mean_odds: float) -> tuple[float, int]:
        """Evidence, and the number of significant segments."""
        least = float(-np.log(self.options.max_evalue))
        found = [self.rate * s - np.log(self.scale * n) for s in segments]
        kept = [x for x in found if x >= least]
        if kept:
            return float(sum(kept)), len(kept)
        grade = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        if found:
            return float(FAINT * (1 + grade(max(found) - least))), 0
        return float(FAINT * grade(mean_odds)) if n else 0.0, 0

    def evidence(self, text: str) -> tuple[float, int]:
        found, n, mean_odds = self.passages(text)
        return self.surprise([s for _, _, s in found], n, mean_odds)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.log1p(evidence))))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of (x, label y) rows that occur n times, by Newton steps with a small ridge on the slope."""
    w = np.array([0.0, np.log(((n * y).sum() + 0.5) / ((n * (1 - y)).sum() + 0.5))])
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (n * p * (1 - p))[:, None]) + np.diag([ridge, 1e-3]), a.T @ (n * (y - p)) - np.array([ridge * w[0], 0]))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0)), float(w[1])


_FOUND = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("weight", pa.float64()), ("n_tokens", pa.int64()), ("mean_odds", pa.float64()), ("segments", pa.list_(pa.float64()))])
_EVIDENCE = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("weight", pa.float64()), ("evidence", pa.float64())])
_STEPS = 1000  #: of log evidence in the histogram that the curve is fitted to


def fit(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> ToxicityModel:
    bits = options.bits
    corpus, _ = _gathered(docs.select("text").mapInArrow(_counted(bits, 1, False), "bucket long, kind int, n double"), bits, 1)
    sample = checkpointed(training_documents(docs, labels, options))
    held, rows = _gathered(_labelled(docs, sample.filter("part < 3")).select("text", "kind", "weight").mapInArrow(_counted(bits, 2, True), "bucket long, kind int, n double"), bits, 2)
    scores, odds = token_scores(held, rows, corpus[0], options)
    model = ToxicityModel(scores, odds, solve_lambda(scores, corpus[0]), 1.0, 0.0, -10.0, options)

    def segments(batches: Batches) -> Batches:
        for b in slices(batches):
            found = [model.passages(t) for t in texts_of(b.column("text"))]
            yield rows_to_batch(_FOUND, [b.column("kind"), b.column("part").cast(pa.int32()), b.column("weight"), [n for _, n, _ in found], [m for _, _, m in found], [[s for _, _, s in x] for x, _, _ in found]])

    found = checkpointed(_labelled(docs, sample).mapInArrow(segments, "kind int, part int, weight double, n_tokens long, mean_odds double, segments array<double>"))
    best = F.array_max("segments")
    clean = found.filter("kind = 0").agg(F.sum(F.when(best > 0, F.col("weight"))).alias("hits"), F.min(F.when(best > 0, best)).alias("least"), F.sum(F.col("n_tokens") * F.col("weight")).alias("n")).first()
    if clean["hits"]:
        model.scale = float(np.clip(clean["hits"] * np.exp(min(model.rate * clean["least"], 50)) / clean["n"], 1e-3, 1e3))

    def surprises(batches: Batches) -> Batches:
        for b in slices(batches):
            own = [model.surprise(*x)[0] for x in zip(*(b.column(c).to_pylist() for c in ("segments", "n_tokens", "mean_odds")), strict=True)]
            yield rows_to_batch(_EVIDENCE, [b.column("kind"), b.column("part"), b.column("weight"), own])

    evidence = found.mapInArrow(surprises, "kind int, part int, weight double, evidence double").withColumn("step", F.round(F.log1p("evidence") * _STEPS).cast("long"))
    tried = evidence.groupBy("kind", F.col("part") == 3, "step").agg(F.sum("weight").alias("n")).collect()  # a few bytes for each step and label
    last = [x for x in tried if x[1]]
    last = last if len({x["kind"] for x in last}) == 2 else tried
    if last:
        x, y, n = (np.array([float(r[c]) for r in last]) for c in ("step", "kind", "n"))
        model.slope, model.intercept = _logistic(x / _STEPS, y, n)
    return model


_REPORT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int32()), ("evidence", pa.float64())])


def toxicity_report(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, evidence; one row per row of docs."""
    model = fit(docs, labels, options)

    def run(batches: Batches) -> Batches:
        for b in slices(batches):
            found = [model.evidence(t) for t in texts_of(b.column("text"))]
            evidence = np.array([x for x, _ in found])
            score = model.probability(evidence)
            yield rows_to_batch(_REPORT, [b.column("doc_id"), b.column("held_out"), score, (score >= 0.5).astype(np.int32), [n for _, n in found], evidence])

    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % options.folds == 0, F.lit(False))
    return keyed.withColumn("held_out", held_out).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages int, evidence double")
