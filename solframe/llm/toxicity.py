"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel of two strings counts the three-letter subsequences that both have, each weighted down by the letters it
spans (Lodhi et al., 2002), so an insult with gaps or inserted characters keeps most of its similarity. A sentence is a
bag of strings, and its score is that of its worst string; a text's score is that of its worst sentence.

Training is on labelled sentences. Labels mark whole texts: all sentences of a clean text are clean; of a toxic text,
those are labelled toxic that hold a string which stands out in toxic texts, and, round by round, the worst sentence of
a text that has none, if the machine agrees (multiple-instance learning). Sentences that remain are not examples.
Landmarks are strings that stand out, and some ordinary ones. Strings are mapped to the space that the landmarks span
(Nystroem) and a linear machine is fitted there to what makes toxic sentences toxic and to ordinary strings; the worst
strings of clean sentences that it takes for toxic join its examples, and it is fitted again. The fit sees a bounded
sample of labelled rows.

Scoring: a linear machine over kernel values is a weight for each subsequence, so one table of weights scores any
string in a pass over its subsequences, and nothing grows with the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices

#: Decay for each letter spanned; the most letters spanned; character classes; the longest string taken at once.
DECAY, SPAN, CLASSES, LONGEST = 0.7, 7, 64, 32
#: The sample: at most so many toxic and clean labelled texts, of at most so many characters each.
TOXIC, CLEAN, CHARS = 1500, 3000, 20_000
#: Landmarks out of toxic texts and ordinary ones; rounds of mining; strings that a worker remembers.
STANDOUT, ORDINARY, ROUNDS, MEMO = 256, 256, 3, 120_000
#: Strings that stand out most and are examples in any case.
FREQUENT = 64
#: Strings whose features are taken at once in the fit.
AT_ONCE = 1000
#: Price of an example on the wrong side.
COST = 30.0
#: predicted is 1 from this score on.
THRESHOLD = 0.7

_SENTENCE = re.compile(r"[.!?\n]+")
_SPELLED = re.compile(r"(?<!\S)\w(?:[ \t]\w){2,}(?!\S)")
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_~`“”«»…/\\+="
_INNER = re.compile(r"[\W_]+")


def strings(text: str) -> set[str]:
    """The distinct strings of a text: its words, words without inner marks, and words spelled with spaces."""
    low = text.lower()
    found = {w.strip(_EDGE) for w in set(low.split())}
    found |= {_INNER.sub("", w) for w in found if not w.isalnum()}
    found |= {re.sub(r"[ \t]", "", m) for m in _SPELLED.findall(low)}
    found.discard("")
    return found


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def _class_of() -> np.ndarray:
    """Class of each character below U+0250: 0 is a gap."""
    table = np.zeros(0x250, np.int32)
    for c in range(0x250):
        ch = chr(c)
        table[c] = 1 + c - 97 if "a" <= ch <= "z" else 59 + c % 5 if ch.isdigit() else 27 + c % 32 if ch.isalpha() else 0
    return table


_TABLE = _class_of()
_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Places of the subsequences of a string of n characters, their weights, and its self-similarity's root."""
    if n not in _TRIPLES:
        at = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
        places = np.array(at, np.int64).reshape(-1, 3)
        weights = DECAY ** (places[:, 2] - places[:, 0] + 1.0)
        _TRIPLES[n] = places, weights.astype(np.float32), float(np.sqrt((weights**2).sum())) or 1.0
    return _TRIPLES[n]


def _pieces(s: str) -> list[str]:
    return [s] if len(s) <= LONGEST else [s[i : i + LONGEST] for i in range(0, len(s) - LONGEST // 2, LONGEST // 2)]


def _coded(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For strings of each length: their places in the batch, codes of their subsequences (-1 with a gap), weights."""
    lengths = np.fromiter(map(len, batch), np.int64, len(batch))
    for n in np.unique(lengths):
        if n < 3:
            continue
        where = np.flatnonzero(lengths == n)
        places, weights, norm = _triples(int(n))
        for at in range(0, len(where), 4000):
            some = where[at : at + 4000]
            points = np.frombuffer("".join(batch[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), n)
            c = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], 27 + (points % 32).astype(np.int32))
            a, b, d = (c[:, places[:, k]] for k in range(3))
            codes = (a * CLASSES + b) * CLASSES + d
            yield some, np.where((a > 0) & (b > 0) & (d > 0), codes, -1), weights / norm


def score_strings(batch: list[str], table: np.ndarray) -> np.ndarray:
    """Score of each string before the intercept. table: a weight for each code, 0 in its last place for gaps."""
    split = [_pieces(s) for s in batch]
    flat = [p for ps in split for p in ps]
    out = np.zeros(len(flat), np.float32)
    for some, codes, weights in _coded(flat):
        out[some] = table[codes] @ weights
    if len(flat) == len(batch):
        return out
    ends = np.cumsum([len(p) for p in split])
    return np.maximum.reduceat(out, np.concatenate(([0], ends[:-1])))


def _vectors(batch: list[str], codes_of: dict[int, int]) -> np.ndarray:
    """Explicit kernel features of the strings, for the subsequences in `codes_of` only."""
    index = np.full(CLASSES**3 + 1, -1, np.int64)
    index[list(codes_of)] = list(codes_of.values())
    out = np.zeros((len(batch), len(codes_of)), np.float32)
    for some, codes, weights in _coded(batch):
        at = index[codes]
        row, column = np.nonzero(at >= 0)
        np.add.at(out, (some[row], at[row, column]), weights[column])
    return out


@dataclass(frozen=True)
class Model:
    table: np.ndarray
    intercept: float
    slope: float
    offset: float

    def probability(self, worst: float) -> float:
        """Score of a text whose worst string has this margin."""
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * (worst + self.intercept) + self.offset, -30, 30))))


NONE = Model(np.zeros(CLASSES**3 + 1, np.float32), -1.0, 1.0, -30.0)


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rng: np.random.Generator, epochs: int = 30) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent (Hsieh et al., 2008); the last weight is the intercept.

    The last column of x is 1.
    """
    square, alpha, w = np.array([(r * r).sum() for r in x]), np.zeros(len(x)), np.zeros(x.shape[1])
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _chance(toxic: int, clean: int, share: float) -> float:
    """Bound on the chance that a string is in so many toxic texts (Chernoff), if it favoured neither kind."""
    part = toxic / (toxic + clean)
    if part <= share:
        return 1.0
    away = part * np.log(part / share) + ((1 - part) * np.log((1 - part) / (1 - share)) if clean else 0.0)
    return float(np.exp(-(toxic + clean) * away))


def _needed(witness: Counter, bags: list[list[str]]) -> Counter:
    """The most frequent strings, and those of the rest that a text needs which has none of the others so far."""
    order = sorted(witness, key=lambda x: (-witness[x], x))
    place = {x: i for i, x in enumerate(order)}
    needed = set(order[:FREQUENT])
    for b in bags:
        known = [x for x in b if x in place]
        if known and needed.isdisjoint(known):
            needed.add(min(known, key=place.get))
    return Counter({x: witness[x] for x in needed})


def _variants(s: str, rng: np.random.Generator) -> list[str]:
    """The string with one character put in, and with a mark put in."""
    at = int(rng.integers(1, len(s)))
    return [s[:at] + chr(97 + int(rng.integers(26))) + s[at:], s[:at] + "-" + s[at:]]


def train(texts: Iterable[tuple[str, int]], seed: int = 7) -> Model:
    """Fit on (text, toxic) pairs. Without texts of both kinds, a model that scores everything near 0.

    The driver holds each distinct string once, and features of AT_ONCE strings; what it frees goes back to the system.
    """
    model = _fitted(texts, seed)
    give_back()
    return model


def _fitted(texts: Iterable[tuple[str, int]], seed: int) -> Model:
    rng = np.random.default_rng(seed)
    once: dict[str, str] = {}
    bags = [([sorted(once.setdefault(x, x) for x in strings(s) if 3 <= len(x) <= LONGEST) for s in sentences(t)], y) for t, y in texts]
    del once
    said = [b for b, y in bags if y]  # the sentences of each toxic text
    harmless = [s for b, y in bags if not y for s in b if s]
    toxic, clean = ([sorted({x for s in b for x in s}) for b, y in bags if bool(y) == kind] for kind in (True, False))
    if not any(toxic) or not any(clean):
        return NONE
    seen, seen_clean = Counter(x for b in toxic for x in b), Counter(x for b in clean for x in b)
    share = len(toxic) / (len(toxic) + len(clean))
    witness = Counter({x: n for x, n in seen.items() if _chance(n, seen_clean[x], share) * len(seen) < 0.05})
    if not witness:
        return NONE
    witness = _needed(witness, toxic)
    ordinary = sorted(seen_clean)
    some = [ordinary[i] for i in rng.choice(len(ordinary), min(len(ordinary), 12_000), replace=False)]
    landmarks = [x for x, _ in sorted(witness.items(), key=lambda w: (-w[1], w[0]))[:STANDOUT]] + some[:ORDINARY]
    codes = sorted({int(c) for _, found, _ in _coded(landmarks) for c in np.unique(found) if c >= 0})
    codes_of = {c: i for i, c in enumerate(codes)}
    basis = _vectors(landmarks, codes_of)
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    good = values > 1e-4 * values[-1]
    project = vectors[:, good] / np.sqrt(values[good])  # K(landmarks)^(-1/2), on its sound directions

    def features(batch: list[str]) -> np.ndarray:
        out = np.ones((len(batch), project.shape[1] + 1))
        for i in range(0, len(batch), AT_ONCE):
            out[i : i + AT_ONCE, :-1] = _vectors(batch[i : i + AT_ONCE], codes_of) @ basis.T @ project
        return out

    table = np.zeros(CLASSES**3 + 1, np.float32)
    hard: set[str] = set()
    intercept = 0.0
    for _ in range(ROUNDS):
        known = sorted(witness)
        positive = known + [v for x in known if witness[x] > 1 for v in _variants(x, rng)]
        negative = some + sorted(hard - set(some))
        x = features(positive + negative)
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        cost = np.full(len(y), COST)
        w = _machine(x, y, cost, rng)
        weights = basis.T @ (project @ w[:-1])
        table[codes] = weights
        intercept = float(w[-1])
        every = sorted(set(ordinary).union(*toxic))
        of = dict(zip(every, (score_strings(every, table) + intercept).tolist()))
        why = lambda sentence: max(sentence, key=lambda x: (of[x], x))
        wrong = {x for x in map(why, harmless) if of[x] > -1}
        hard |= set(sorted(wrong, key=lambda x: (-of[x], x))[:1500])
        # the worst sentence of a toxic text that has no labelled one is labelled toxic, if the machine agrees
        open_texts = [[s for s in b if s] for b in said if not any(x in witness for s in b for x in s)]
        worst = [max(map(why, b), key=lambda x: (of[x], x)) for b in open_texts if b]
        witness += Counter(x for x in worst if of[x] > 0)
    worst = np.array([max((of[x] for x in b), default=-2.0) for b in toxic + clean])
    label = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    slope, offset = _logistic(worst, label)
    return Model(table, intercept, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve with smoothed targets (Platt, 1999), both classes weighing the same."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 1 / n1, 1 / n0)
    design, beta = np.stack([x, np.ones(len(x))], axis=1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - goal)) + np.array([1e-4 * beta[0], 0])
        hessian = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def held_out(doc_id) -> F.col:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str) -> list[tuple[str, int]]:
    """Labelled texts for the fit: TOXIC and CLEAN rows at most, the first by a hash of doc_id, never held-out ones.

    The chosen ids are few enough to broadcast whatever the input.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).filter("_id is not null and _toxic is not null")
    marked = marked.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    order = F.xxhash64("_id")
    ids = marked.filter("_toxic = 1").orderBy(order, "_id").limit(TOXIC).unionByName(marked.filter("_toxic = 0").orderBy(order, "_id").limit(CLEAN))
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).filter(F.length("_text") <= CHARS)
    found = rows.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    return [(r["_text"], int(r["_toxic"])) for r in sorted(found.collect(), key=lambda r: r["_id"])]


class Scorer:
    """Scores texts in a worker, remembering a bounded number of strings."""

    def __init__(self, model: Model) -> None:
        self.model, self.memo = model, {}

    def scores(self, texts: list[str | None]) -> list[float]:
        out = []
        for at in range(0, len(texts), 500):
            bags = [strings(t) if t else () for t in texts[at : at + 500]]
            fresh = list({x for b in bags for x in b if x not in self.memo})
            if len(self.memo) + len(fresh) > MEMO:
                self.memo.clear()
                fresh = list({x for b in bags for x in b})
            self.memo.update(zip(fresh, score_strings(fresh, self.model.table).tolist() if fresh else ()))
            out += [self.model.probability(max(map(self.memo.__getitem__, b), default=-2.0)) for b in bags]
        return out


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    labels: doc_id, toxic (0 or 1); rows with a null play no part, and a text that is labelled twice is toxic if one
    label says so. Rows whose crc32(doc_id) leaves 1 when divided by 3 are held out of the fit. A null or empty text
    gets the score of a text without strings, the lowest there is; repeated rows score alike; an empty table gives no
    rows; other columns, clashing names included, play no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, text, doc_id)))  # a table of fixed size
    rows = docs.select(docs[doc_id].alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in slices(batches, 1024):
            scores = scorer.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs`, all columns, without the rows that `score_toxicity` predicts to be toxic. Cases as there."""
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, text, doc_id)))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in slices(batches, 1024):
            yield batch.filter(pa.array([s < THRESHOLD for s in scorer.scores(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
