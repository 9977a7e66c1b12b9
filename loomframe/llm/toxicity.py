"""Toxic passages by maximum-scoring segments.

A word scores its log-odds between toxic and other labelled documents under an
informative Dirichlet prior (Monroe et al. 2008): a token's prior count follows
its share of all labelled text.  A token is a word or, for words too rare to be
learned whole, its first six, five or four letters.  Tokens whose log-odds are
significant, positive or negative, score their own; all other words score the
log-odds of ordinary words as a whole, between the passages found in toxic texts
with a first guess (FIRST_DRIFT) and the other labelled texts.

In a text the linear-time scan of Ruzzo and Tompa (1999) finds all maximal
segments of positive total.  Scores are made comparable between texts of
different length by the extreme-value statistics of Karlin and Altschul
(1990): a segment of score S among n words is expected K n exp(-lambda S) times
by chance.  lambda solves E[exp(lambda s)] = 1 over the words of texts that are
not toxic, and K is set by the extremes of those texts: one in a hundred (LEVEL)
has a segment expected less than once in a hundred texts, which makes it a
passage.  A document's evidence (best and total log
expectation) goes through a logistic curve fitted on labelled documents scored
with words learned from others.

The classifier is fitted on a bounded sample of labelled rows (MAX_TOXIC and
MAX_OTHER, taken by a hash of doc_id); it keeps every significant token of that
sample.  Scoring reads every text to its end.

Cases: null and empty texts hold no passage and score like any text without
one; rows of a repeated or null doc_id are scored one by one, the labels of a
repeated doc_id as its largest; with no usable labels every score is 0; other
columns are ignored, whatever their names.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.session import durable, release

#: Labelled rows that the classifier is fitted on, at most.
MAX_TOXIC, MAX_OTHER = 6000, 12000
#: Share of all labelled tokens that the Dirichlet prior is worth; least significance of a token, and least log-odds of one for toxicity.
PRIOR, LEAST_Z, LEAST_ODDS = 0.05, 3.0, 1.5
#: Cost of an ordinary word before it is estimated; expected chance passages of a text.
FIRST_DRIFT, LEVEL = 0.25, 0.01
PREFIXES = (6, 5, 4)
#: Curve where too few labelled rows are left to fit one.
DEFAULT_CURVE = (-3.0, 2.5, 0.0)
WORD = re.compile(r"[^\W\d_]+")
#: Words that a worker remembers the scores of.
REMEMBERED = 1 << 15


def tokens(word: str) -> list[str]:
    """The word and its prefixes, as learned tokens; prefixes end in ``*``."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class Lookup(dict):
    """Scores of words that begin like a learned token, filled as they come; other words need no memory."""

    def __init__(self, scores: dict[str, float], drift: float):
        self.scores, self.ordinary = scores, -drift
        self.starts = frozenset(t.rstrip("*")[: min(PREFIXES)] for t in scores)

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        own = next((self.scores[t] for t in tokens(word) if t in self.scores), self.ordinary)
        self[word] = own
        return own

    def of(self, words: list[str]) -> np.ndarray:
        starts, ordinary, n = self.starts, self.ordinary, min(PREFIXES)
        return np.array([self[w] if w[:n] in starts else ordinary for w in words], np.float64)


@dataclass
class Model:
    """Scores of learned tokens and the calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    drift: float = FIRST_DRIFT
    rate: float = 1.0
    k: float = 1.0
    curve: tuple[float, float, float] | None = None

    def __post_init__(self):
        self.lookup = Lookup(self.scores, self.drift)

    def word_scores(self, text: str) -> np.ndarray:
        """The score of every word in order."""
        return self.lookup.of(WORD.findall(text.lower()))

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments (first word, word after the last, score) and the number of words."""
        scores = self.word_scores(text)
        return maximal(scores), len(scores)

    def evidence(self, text: str) -> tuple[float, float, list[tuple[int, int, float, float]]]:
        """Best and total -log expectation, and the significant passages with theirs."""
        found, n = self.segments(text)
        chance = [(a, b, s, self.rate * s - math.log(self.k * max(n, 1))) for a, b, s in found]
        passages = [c for c in chance if c[3] >= -math.log(LEVEL)]
        best = max((c[3] for c in chance), default=0.0)
        return max(0.0, best), sum(c[3] for c in passages), passages

    def probability(self, best: float, total: float) -> float:
        if self.curve is None:
            return 0.0
        z = self.curve[0] + self.curve[1] * math.log1p(best) + self.curve[2] * math.log1p(total)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def maximal(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal segments (first, after the last, total) of a sequence of scores.

    Each kept candidate remembers the last one before it with a smaller left
    sum; a search follows these marks, so the scan is linear.
    """
    kept: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, after, mark
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for i in np.flatnonzero(scores > 0).tolist():
        item = [float(sums[i]), float(sums[i + 1]), i, i + 1]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= item[0]:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= item[1]:
                kept.append((*item, j))
                break
            item[0], item[2] = kept[j][0], kept[j][2]
            mark = kept[j][4]
            del kept[j:]
            j = mark
    return [(first, end, right - left) for left, right, first, end, _ in kept]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string")) % 4


def labelled_sample(labels: DataFrame, max_toxic: int, max_other: int) -> DataFrame:
    """(doc_id, toxic, fold) of a bounded sample outside the held-out fold."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("fold", fold(F.col("doc_id")).cast("int")).where("fold != 2")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return rows.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(rows.where("toxic = 0").orderBy(*order).limit(max_other))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and other texts that hold each token, summed within the task as far as memory allows.

    A text counts once for a token, as words repeated in one text say little.
    """
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys, n = [k for k, _ in seen], list(seen.values())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([t for _, t in seen], pa.int32()), pa.array(n, pa.int64())], names=["token", "toxic", "n"])

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = set(WORD.findall((text.as_py() or "").lower()))
            seen.update((t, toxic) for t in {t for w in words for t in tokens(w)})
            seen["", toxic] += len(words)
            if len(seen) > 300_000:
                yield flush()
                seen.clear()
    if seen:
        yield flush()


def log_odds(y1: float, y0: float, n1: float, n0: float) -> tuple[float, float]:
    """Log-odds ratio under the prior, and its significance."""
    a, a0 = PRIOR * (y1 + y0), PRIOR * (n1 + n0)
    p, q = y1 + a, y0 + a
    value = math.log(p / max(n1 + a0 - p, 1.0)) - math.log(q / max(n0 + a0 - q, 1.0))
    return value, value / math.sqrt(1 / p + 1 / q)


def significant(y1: Column, y0: Column, n1: int, n0: int) -> Column:
    """Whether a token's log-odds are significant, as ``log_odds`` has them (with some slack)."""
    a, a0 = PRIOR * (y1 + y0), PRIOR * (n1 + n0)
    p, q = y1 + a, y0 + a
    value = F.log(p / F.greatest(n1 + a0 - p, F.lit(1.0))) - F.log(q / F.greatest(n0 + a0 - q, F.lit(1.0)))
    least = (LEAST_Z - 1e-6) * F.sqrt(1 / p + 1 / q)
    return (y1 + y0 > 0) & (((y1 > 0) & (value >= LEAST_ODDS - 1e-6) & (value >= least)) | (value <= -least))


def decay(counts: dict[float, int]) -> float:
    """lambda with E[exp(lambda s)] = 1 over words with so many of each score; 1 where there is none."""
    total = sum(counts.values())
    if not total or max(counts) <= 0 or sum(s * n for s, n in counts.items()) >= 0:
        return 1.0
    f = lambda x: sum(n * math.expm1(min(x * s, 500.0)) for s, n in counts.items())
    hi = 1e-3
    while f(hi) < 0:
        hi *= 2
    lo = 0.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def chance_factor(seen: list[tuple[int, float]], rate: float, level: float = LEVEL) -> float:
    """K for (words, best segment) of ordinary texts: so that a share ``level`` of them has a passage.

    A text has a passage from K n exp(-rate best) <= level on; ``rate`` gives the
    slope of the tail, the texts of largest best its height.
    """
    if not seen:
        return 1.0
    high = sorted((rate * s - math.log(max(n, 1)) for n, s in seen), reverse=True)
    return level * math.exp(high[min(int(level * len(high)), len(high) - 1)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; x holds a column of ones first."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)]) + 1e-9 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty @ w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learned(rows: list[tuple[str, int, int]]) -> Model:
    """Words from (token, toxic texts, other texts); the token "" holds the totals."""
    n1, n0 = next((y1, y0) for t, y1, y0 in rows if t == "")
    scores = {}
    for t, y1, y0 in rows:
        if t and y1 + y0 and n1 and n0:
            value, z = log_odds(y1, y0, n1, n0)
            if (z >= LEAST_Z and value >= LEAST_ODDS and y1) or z <= -LEAST_Z:
                scores[t] = value
    return Model(scores, curve=DEFAULT_CURVE if any(v > 0 for v in scores.values()) else None)


def ordinary_cost(inside: tuple[int, int], outside: tuple[int, int]) -> float:
    """Minus the log-odds of an ordinary word, from (ordinary words, words) of passages and of other texts."""
    share = lambda pair: (pair[0] + 1) / (pair[1] + 2)
    return max(0.01, math.log(share(outside)) - math.log(share(inside)))


def _passages_words(model: Model):
    """(ordinary words, words) of each text: of its passages if it is toxic, else of all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                scores = model.word_scores(text.as_py() or "")
                if toxic:
                    scores = np.concatenate([np.zeros(0), *(scores[a:b] for a, b, _ in maximal(scores))])
                out.append((int((scores == -model.drift).sum()), len(scores)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o for o, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], names=["toxic", "ordinary", "words"])

    return run


def _chances(model: Model):
    """Of ordinary texts: words of each score (summed within the task), and each text's words and best segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            words, best = [], []
            for text in batch.column(1):
                scores = model.word_scores(text.as_py() or "")
                values, n = np.unique(scores, return_counts=True)
                counts.update(dict(zip(values.tolist(), n.tolist(), strict=True)))
                words.append(len(scores))
                best.append(max((s for *_, s in maximal(scores)), default=0.0))
            yield as_batch([None] * len(words), words, best)
        yield as_batch(list(counts), list(counts.values()), [None] * len(counts))

    def as_batch(value: list, n: list, best: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(value, pa.float64()), pa.array(n, pa.int64()), pa.array(best, pa.float64())], names=["value", "n", "best"])

    return run


def calibrated(model: Model, rows: DataFrame) -> Model:
    """The model with the cost of ordinary words, lambda and K from labelled rows (toxic, text).

    The driver gets a pair of sums, a row for each ordinary text of the bounded
    sample, and a count for each learned score.
    """
    rows = rows.select(F.col("toxic").cast("int").alias("toxic"), "text")
    sums = rows.mapInArrow(_passages_words(model), "toxic int, ordinary long, words long").groupBy("toxic").agg(F.sum("ordinary").alias("o"), F.sum("words").alias("w"))
    found = {r["toxic"]: (r["o"], r["w"]) for r in sums.collect()}
    model = Model(model.scores, ordinary_cost(found.get(1, (0, 0)), found.get(0, (0, 0))), curve=model.curve)
    seen = rows.where("toxic = 0").mapInArrow(_chances(model), "value double, n long, best double")
    seen = seen.where("value is null").unionByName(seen.where("value is not null").groupBy("value").agg(F.sum("n").alias("n")).withColumn("best", F.lit(None).cast("double"))).collect()
    rate = decay({r["value"]: r["n"] for r in seen if r["value"] is not None})
    k = chance_factor([(r["n"], r["best"]) for r in seen if r["value"] is None], rate)
    return Model(model.scores, model.drift, rate, k, model.curve)


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Model:
    """Fit on the labelled sample outside the held-out fold.

    Words learned on folds 0 and 1 score fold 3, which gives the curve; the
    words of the final model are learned on all three.

    The sample's ids (at most max_toxic + max_other rows of two numbers) are
    broadcast.  The driver gets the sample's significant tokens: each stands in
    several of its texts, so they are a fraction of its distinct words.
    """
    sample = labelled_sample(labels, max_toxic, max_other)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    # written, as several passes read it
    rows = durable(rows.select("toxic", "fold", "text"), "labelled")
    counted = rows.select((F.col("toxic") + 2 * (F.col("fold") == 3).cast("int")).alias("kind"), "text").mapInArrow(_counts, "token string, kind int, n long")
    part = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))
    table = counted.groupBy("token").agg(part(1, 3).alias("y1"), part(0, 2).alias("y0"), part(1).alias("first1"), part(0).alias("first0"))
    table = durable(table.where("y1 + y0 >= 3 or token = ''"), "tokens")
    totals = table.where("token = ''").first()
    if totals is None or not totals["y1"] or not totals["y0"]:
        return Model()
    useful = significant(F.col("y1"), F.col("y0"), totals["y1"], totals["y0"])
    if totals["first1"] and totals["first0"]:
        useful = useful | significant(F.col("first1"), F.col("first0"), totals["first1"], totals["first0"])
    top = [totals, *table.where((F.col("token") != "") & useful).orderBy("token").collect()]
    release(table)
    whole = learned([(r["token"], r["y1"], r["y0"]) for r in top])
    if whole.curve is None:
        return whole
    whole = calibrated(whole, rows)
    model = learned([(r["token"], r["first1"], r["first0"]) for r in top])
    if model.curve is None:
        return whole
    model = calibrated(model, rows.where("fold = 3"))

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.evidence(t.as_py() or "")[:2] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], names=["toxic", "best", "total"])

    seen = rows.where("fold = 3").select(F.col("toxic").cast("int"), "text").mapInArrow(evidences, "toxic int, best double, total double").collect()
    release(rows)
    if len({r["toxic"] for r in seen}) < 2:
        return whole
    seen.sort()
    x = np.array([[1.0, math.log1p(r["best"]), math.log1p(r["total"])] for r in seen])
    whole.curve = logistic(x, np.array([float(r["toxic"] == 1) for r in seen]))
    return whole


PASSAGES = "array<struct<first_word:int,end_word:int,score:double,evidence:double>>"


def score(docs: DataFrame, model: Model, passages: bool = False, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and a struct called ``name``: score, number n of passages (and the passages themselves)."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            got = [model.evidence(t.as_py() or "") for t in batch]
            out = {"score": pa.array([model.probability(b, s) for b, s, _ in got], pa.float64()), "n": pa.array([len(p) for *_, p in got], pa.int32())}
            if passages:
                kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("evidence", pa.float64())]))
                out["passages"] = pa.array([[dict(zip(("first_word", "end_word", "score", "evidence"), q, strict=True)) for q in p] for *_, p in got], kind)
            yield pa.StructArray.from_arrays(list(out.values()), names=list(out))

    kind = "score double, n int" + (f", passages {PASSAGES}" if passages else "")
    return docs.withColumn(name, F.arrow_udf(run, kind)(F.col("text").cast("string")))
