"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics.

A token is a word in lower case. Its score is the log of how many more toxic documents use it than clean ones, with a
Dirichlet prior on both rates; the model learns a word once per text, the scan scores it anew where it was absent for ``NEAR`` tokens. Until then the
scores of a toxic word's repeats fall by ``DAMP`` each and do not count for the length of the text, so repeating a word
never lowers the evidence, nor does it make evidence of a word that is none. The prior is informative: an
entry's prior is what its shorter spelling shows (the word, then its first 6, 5, 4, 3 characters, then no preference),
so an unseen word is scored by its beginning. ``DRIFT`` is subtracted from every score, which keeps the expected score
of clean text negative.

One linear scan finds all maximal-scoring segments of a document (Ruzzo and Tompa 1999). For a segment of score S in a
text of n tokens (repeats aside), chance gives about E = K n exp(-lambda S) segments as good (Karlin and Altschul 1990). lambda is the
positive root of mean(exp(lambda s)) = 1 over the tokens of clean text, K is the maximum-likelihood value for the best
segments of clean texts. Segments with E below ``SIGNIFICANT`` are passages; a document's evidence is the sum of
-log(E) over them, and a logistic curve over it gives the score.

The model is fitted on a bounded sample of about ``sample`` labelled documents and keeps the ``entries`` most frequent
entries (two counts each); the calibration reads one row of numbers per sampled document. Everything else covers all
documents and whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LETTERS, Scores, batch, drawn, slices, stage, text_batches

SAMPLE = 24_000
ENTRIES = 150_000
PREFIXES = (6, 5, 4, 3)
PRIOR = 4.0  # weight of the shorter spelling, in tokens
DRIFT = 1.0
NEAR = 32
DAMP = 0.25
SIGNIFICANT = 0.05
LIMIT = 0.7
COUNTED = {"toxic": pa.int32(), "entry": pa.string(), "n": pa.int64()}
BIN = 0.05  # width of the bins in which scores of clean tokens are counted


def spellings(word: str) -> list[str]:
    """The entries of a word, shortest first: prefixes end in a star."""
    return [word[:n] + "*" for n in reversed(PREFIXES) if len(word) >= n] + [word]


class LogOdds:
    """Token scores from counts in clean and toxic text."""

    def __init__(self, counts: dict[str, tuple[int, int]], clean: int, toxic: int):
        self.counts, self.clean, self.toxic = counts, max(clean, 1), max(toxic, 1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def score(self, word: str) -> np.ndarray:
        ratio = 1.0
        for entry in spellings(word):
            clean, toxic = self.counts.get(entry, (0, 0))
            whole = self.clean + ratio * self.toxic
            toxic_rate = (toxic + PRIOR * ratio * self.toxic / whole) / self.toxic
            clean_rate = (clean + PRIOR * self.clean / whole) / self.clean
            ratio = toxic_rate / clean_rate
        return np.array([math.log(ratio) - DRIFT])

    def scores(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Scores of a text's tokens, and how many of them are no repeats.

        A word is a repeat within ``NEAR`` tokens of where it last was. Its k-th repeat has its score times ``DAMP`` to
        the power of k if that is positive, else it tells nothing new.
        """
        if not hasattr(self, "kept"):
            self.kept = Scores(1, self.score)
        out = self.kept.of(words)[:, 0].copy()
        seen: dict[str, tuple[int, int]] = {}
        fresh = 0
        for at, word in enumerate(words):
            last, times = seen.get(word, (-NEAR, 0))
            times = times + 1 if at - last < NEAR else 0
            seen[word] = at, times
            if not times:
                fresh += 1
            else:
                out[at] = out[at] * DAMP**times if out[at] > 0 else -DRIFT
        return out, fresh


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end), in order, in time linear in the number of scores.

    Candidates are (sum before, sum after, start, end, link). The link leads to the last candidate with a lower sum
    before; those in between can never be joined again and are skipped. A candidate without one ends all before it.
    """
    sums = np.cumsum(scores).tolist()
    done: list[tuple] = []
    stack: list[tuple[float, float, int, int, int]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        before, after, start = (sums[at - 1] if at else 0.0), sums[at], at
        while True:
            place = len(stack) - 1
            while place >= 0 and stack[place][0] >= before:
                place = stack[place][4]
            if place < 0:
                done += stack
                stack.clear()
                break
            if stack[place][1] >= after:
                break
            before, start = stack[place][0], stack[place][2]
            del stack[place:]
        stack.append((before, after, start, at + 1, place))
    return [(after - before, start, end) for before, after, start, end, _ in done + stack]


class Detector:
    """Log-odds with the two constants of the extreme-value law and the logistic curve."""

    def __init__(self, odds: LogOdds, rate: float, scale: float, curve: tuple[float, float] = (-3.0, 1.0)):
        self.odds, self.rate, self.scale, self.curve = odds, rate, scale, curve

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant passages as (first character, end, -log E)."""
        words = list(LETTERS.finditer(text))
        scores, fresh = self.odds.scores([w.group().lower() for w in words])
        out = []
        for score, start, end in segments(scores):
            worth = self.worth(score, fresh)
            if worth > -math.log(SIGNIFICANT):
                out.append((words[start].start(), words[end - 1].end(), worth))
        return out

    def worth(self, score: float, tokens: int) -> float:
        return self.rate * score - math.log(self.scale * tokens)

    def evidence(self, text: str) -> float:
        """Sum of -log E over the significant segments of a text; 0 without any."""
        words = LETTERS.findall(text.lower())
        scores, fresh = self.odds.scores(words)
        worths = (self.worth(score, fresh) for score, _, _ in segments(scores))
        return sum(w for w in worths if w > -math.log(SIGNIFICANT))

    def probability(self, evidence: float) -> float:
        base, slope = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, base + slope * math.log1p(evidence)))))


def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of labelled texts (toxic, text), a word once per text, batch by batch; ``""`` counts the tokens."""
    for rows in batches:
        words: tuple[Counter, Counter] = (Counter(), Counter())
        marks = rows.column(0).to_pylist()
        at = 0
        for part in slices(rows.column(1)):
            for text in part:
                words[marks[at]].update(set(LETTERS.findall(text.lower())))
                at += 1
        for mark in (0, 1):
            entries: Counter = Counter()
            for word, n in words[mark].items():
                entries[""] += n
                for entry in spellings(word):
                    entries[entry] += n
            yield batch(COUNTED, ([mark] * len(entries), list(entries), list(entries.values())))


def root_of(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of mean(exp(x * value)) = 1; 1 if there is none."""
    if not len(values) or values.max() <= 0 or np.average(values, weights=weights) >= 0:
        return 1.0

    def mean(x: float) -> float:
        return float(np.average(np.exp(np.minimum(x * values, 700)), weights=weights))

    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return high


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Base and slope of a logistic curve by Newton's method with a small ridge."""
    design = np.stack([np.ones_like(x), x], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - 1e-3 * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    entries: int = ENTRIES,
) -> Detector:
    """A detector from documents whose id has a label 0 or 1.

    A document labelled both 0 and 1 counts as toxic. Null ids, null labels and other labels teach nothing. Without
    toxic or clean examples every score is the share of toxic ones among the labelled documents.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    text_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total, toxic_total = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not total or not toxic_total or toxic_total == total:
        share = toxic_total / total if total else 0.0
        base = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Detector(LogOdds({}, 1, 1), 1.0, 1.0, (base, 0.0))
    # At most ``sample`` ids or so: a proven bound for the broadcast.
    chosen = marks.where(drawn(F.col("id"), min(1.0, sample / total)))
    taught = stage(texts.join(F.broadcast(chosen), "id").select("id", "toxic", "text"), "taught")
    counted = taught.select("toxic", "text").mapInArrow(counts_of, "toxic int, entry string, n long")
    pairs = counted.groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"),
    )
    top = pairs.orderBy(F.desc(F.col("clean") + F.col("toxic")), "entry").limit(entries + 1)
    known = {r["entry"]: (r["clean"], r["toxic"]) for r in top.toLocalIterator()}
    tokens = known.pop("", (1, 1))
    odds = LogOdds(known, *tokens)
    shared = docs.sparkSession.sparkContext.broadcast(odds)

    @F.arrow_udf("tokens long, best double, bins map<int,long>")
    def scored(column: pa.Array) -> pa.Array:
        out = []
        for part in slices(column):
            for text in part:
                scores, fresh = shared.value.scores(LETTERS.findall(text.lower()))
                bins = Counter(np.floor(scores / BIN).astype(int).tolist())
                best = max((s for s, _, _ in segments(scores)), default=0.0)
                out.append({"tokens": fresh, "best": best, "bins": list(bins.items())})
        kinds = [("tokens", pa.int64()), ("best", pa.float64()), ("bins", pa.map_(pa.int32(), pa.int64()))]
        return pa.array(out, pa.struct(kinds))

    clean = stage(taught.where("toxic = 0").select(scored(F.col("text")).alias("s")).select("s.*"), "clean")
    bins = clean.select(F.explode("bins").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect()
    rate = root_of(np.array([(r["bin"] + 0.5) * BIN for r in bins]), np.array([float(r["n"]) for r in bins]))
    several = clean.where("tokens > 0").agg(F.count("*"), F.sum(F.col("tokens") * F.exp(-F.col("best") * rate))).first()
    scale = max(several[0] / several[1], 1e-9) if several[0] else 1.0
    detector = Detector(odds, rate, scale)
    weighed = taught.select("toxic", evidence(docs, detector, F.col("text")).alias("evidence")).toPandas()
    detector.curve = logistic(np.log1p(weighed["evidence"].to_numpy()), weighed["toxic"].to_numpy().astype(float))
    return detector


def evidence(docs: DataFrame, detector: Detector, text: Column) -> Column:
    shared = text_batches(docs.sparkSession).sparkContext.broadcast(detector)

    @F.arrow_udf("double")
    def weighed(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.evidence(t) for part in slices(texts) for t in part], pa.float64())

    return weighed(text)


def passages(docs: DataFrame, detector: Detector, text: Column) -> Column:
    """A column with the significant passages of a text: start and end (code points) and -log E."""
    shared = text_batches(docs.sparkSession).sparkContext.broadcast(detector)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("worth", pa.float64())]))

    @F.arrow_udf("array<struct<start:long,end:long,worth:double>>")
    def found(texts: pa.Array) -> pa.Array:
        every = (shared.value.passages(t) for part in slices(texts) for t in part)
        return pa.array([[dict(zip(("start", "end", "worth"), p)) for p in one] for one in every], kind)

    return found(text)


def probability(docs: DataFrame, detector: Detector, text: Column) -> Column:
    """A column with the score (0 to 1) of every whole text; null and empty texts have no evidence."""
    shared = text_batches(docs.sparkSession).sparkContext.broadcast(detector)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        d = shared.value
        return pa.array([d.probability(d.evidence(t)) for part in slices(texts) for t in part], pa.float64())

    return scored(text)
