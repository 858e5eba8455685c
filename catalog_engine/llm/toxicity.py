"""Toxicity (operator 9): a linear-chain conditional random field over words.

Two tags, clean and toxic. A word's feature is its lexicon entry, a whole word or a stem that
it begins with (the longest that fits), or none; the chain has start and transition weights.
Tags to learn from come from document labels: in a toxic document the lexicon words are
toxic, all other words of all documents are clean. The lexicon is chosen greedily: in each
round the word or stem that explains most toxic documents which no earlier one explains,
among those that clean documents use significantly less; so words that a group of copies
happens to share don't enter once its insults do.

Weights maximise the penalised likelihood over word windows of a bounded sample of labelled
documents (at most about per_class of each label). Scoring runs forward-backward over every
whole text: 2x2 factors are multiplied by a parallel scan. A document's score combines the
largest marginal and the expected number of toxic words by a logistic curve fitted on the
same sample; offending offsets are the runs of words whose marginal is at least one half.

Defined cases: null and empty texts get the score of a document without toxic words; without
labels of both kinds every score is 0; labels on unknown or null ids are ignored; a document
labelled twice counts as toxic if any label says so; of several texts of a labelled id the first
in order is learned from; repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.llm.common import id_text, is_held_out, map_slices

WORD = re.compile(r"\w+")


STEMS = range(4, 7)
"""Lengths of word beginnings that may be lexicon entries; they end in a star there."""
CACHE_WORDS = 150_000


def entries(word: str) -> list[str]:
    """Lexicon entries that would hold a word, the narrowest first."""
    return [word, *(f"{word[:n]}*" for n in reversed(STEMS) if n < len(word))]


class WordFeatures(dict):
    """Feature of each word met, in bounded space: its narrowest lexicon entry, or 0."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = next((self.lexicon[e] for e in entries(word) if e in self.lexicon), 0)
        self[word] = found
        return found


@dataclass
class Model:
    """Weights of the field and of the document score."""

    lexicon: dict[str, int] = field(default_factory=dict)  # entry -> feature, from 1 on; 0: any other word
    emission: np.ndarray = field(default_factory=lambda: np.zeros(1))  # weight of the toxic tag by feature
    start: float = -9.0  # weight of the toxic tag at the first word
    change: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)


def _scan(factors: np.ndarray) -> np.ndarray:
    """All prefix products of 2x2 factors (log depth), each scaled to a largest entry of 1."""
    out, step = factors.copy(), 1
    while step < len(out):
        out[step:] = np.einsum("nij,njk->nik", out[:-step], out[step:])
        out[step:] /= out[step:].max(axis=(1, 2), keepdims=True)
        step *= 2
    return out


def marginals(model: Model, features: np.ndarray) -> np.ndarray:
    """Probability of the toxic tag at each word, by forward-backward."""
    n = len(features)
    if not n:
        return np.zeros(0)
    local = np.stack([np.ones(n), np.exp(model.emission[features])], axis=1)
    # factor t takes the tag of word t-1 to that of word t
    factors = np.exp(model.change)[None] * local[:, None, :]
    factors[0] = np.array([[1.0, math.exp(model.start)]] * 2) * local[0]
    forward = _scan(factors)[:, 0, :]
    backward = np.ones((n, 2))
    if n > 1:
        tail = _scan(factors[:0:-1].transpose(0, 2, 1)).sum(axis=1)  # transposed products from the end
        backward[:-1] = tail[::-1]
    joint = forward * backward
    return joint[:, 1] / joint.sum(axis=1)


def evidence(p: np.ndarray) -> tuple[float, float]:
    """Largest marginal (as log odds, held within 12) and expected number of toxic words."""
    if not len(p):
        return -12.0, 0.0
    top = float(np.clip(p.max(), 6e-6, 1 - 6e-6))
    return math.log(top / (1 - top)), math.log1p(float(p[p >= 0.05].sum()))


def document_score(model: Model, p: np.ndarray) -> float:
    bias, by_top, by_sum = model.curve
    top, total = evidence(p)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + by_top * top + by_sum * total))))


# --- learning, on the bounded sample

def significance(in_toxic: int, in_clean: int, n_toxic: int, n_clean: int) -> float:
    """Log-likelihood ratio of an entry that toxic documents have more often than clean ones."""
    if in_toxic * n_clean <= in_clean * n_toxic:
        return 0.0
    both, total = in_toxic + in_clean, n_toxic + n_clean
    return 2 * sum(k * math.log(k * total / (n * m)) for k, n, m in (
        (in_toxic, both, n_toxic), (in_clean, both, n_clean),
        (n_toxic - in_toxic, total - both, n_toxic), (n_clean - in_clean, total - both, n_clean)) if k)


def choose_lexicon(toxic: list[set[str]], clean: list[set[str]], most: int = 200, least: float = 25.0) -> list[str]:
    """Greedy cover of the toxic documents by entries that clean ones use significantly less."""
    in_toxic, in_clean = Counter(), Counter()
    for d in toxic:
        in_toxic.update({e for w in d for e in entries(w)})
    in_toxic = Counter({e: c for e, c in in_toxic.items() if c >= 4})
    frequent = set(in_toxic)
    for d in clean:
        in_clean.update({e for w in d for e in entries(w)} & frequent)

    def usable(e: str, count: int) -> bool:
        purity = 200 if e.endswith("*") else 50  # a stem also takes in words that nobody has seen
        return (in_clean[e] * len(toxic) * purity <= in_toxic[e] * len(clean)
                and significance(count, in_clean[e], len(toxic), len(clean)) >= least)

    def narrowed(e: str, counts: Counter) -> str:
        """A stem of which one word makes up half is that word."""
        if not e.endswith("*"):
            return e
        word = max((x for x in counts if not x.endswith("*") and x.startswith(e[:-1])), key=lambda x: (counts[x], x), default=e)
        return word if 2 * counts[word] >= counts[e] else e

    kept = {e for e in frequent if usable(e, in_toxic[e])}
    open_docs = [{e for w in d for e in entries(w)} & kept for d in toxic]
    chosen: list[str] = []
    while len(chosen) < most:
        gain = Counter(e for d in open_docs for e in d)
        if not gain:
            break
        # a use in a clean document outweighs ten more toxic ones, and a stem must explain a
        # quarter more than a whole word; among equals a long stem before a short one
        entry = max(gain, key=lambda e: ((0.8 if e.endswith("*") else 1.0) * gain[e] - 10 * in_clean[e] * len(toxic) / len(clean), not e.endswith("*"), len(e), e))
        entry = narrowed(entry, gain)
        if not usable(entry, gain[entry]):
            break
        chosen.append(entry)
        open_docs = [d for d in open_docs if entry not in d]
    # entries as frequent as the chosen ones, though their documents are covered already
    bar = sorted(in_toxic[e] for e in chosen)[len(chosen) // 2] / 2 if chosen else math.inf
    rest = sorted((e for e in kept if in_toxic[e] >= bar), key=lambda e: (-in_toxic[e], e.endswith("*"), -len(e), e))
    for e in (narrowed(x, in_toxic) for x in rest):
        bare = e.rstrip("*")
        if len(chosen) < most and not any(bare.startswith(x.rstrip("*")) or x.startswith(bare) for x in chosen):
            chosen.append(e)
    return chosen


def _windows(rows: list[tuple[np.ndarray, int]], width: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Feature windows and their tags: around lexicon words, and one clean window per document."""
    feats, tags = [], []
    for features, toxic in rows:
        hits = np.flatnonzero(features)
        starts = {max(0, int(h) - width // 2) for h in hits[:50]} | {0}
        for s in sorted(starts):
            part = features[s:s + width]
            padded = np.full(width, -1, dtype=np.int64)
            padded[:len(part)] = part
            feats.append(padded)
            tags.append(np.where(padded > 0, toxic, 0))
    return np.array(feats).reshape(-1, width), np.array(tags).reshape(-1, width)


def fit_weights(model: Model, feats: np.ndarray, tags: np.ndarray, rounds: int = 40, penalty: float = 0.02) -> None:
    """Gradient ascent (per-weight steps) on the mean log-likelihood of the windows' tags."""
    n, width = feats.shape
    live = feats >= 0
    f = np.where(live, feats, 0)
    size = len(model.emission)
    seen = np.zeros(size + 5)
    theta = np.concatenate([model.emission, [model.start], model.change.ravel()])
    count = max(1, n)
    for _ in range(rounds):
        emission, start, change = theta[:size], theta[size], theta[size + 1:].reshape(2, 2)
        step = np.exp(change)
        local = np.stack([np.ones((n, width)), np.exp(emission[f])], axis=2)
        alpha, beta = np.zeros((n, width, 2)), np.ones((n, width, 2))
        alpha[:, 0] = local[:, 0] * np.array([1.0, math.exp(start)])
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for t in range(1, width):
            alpha[:, t] = np.where(live[:, t, None], (alpha[:, t - 1] @ step) * local[:, t], alpha[:, t - 1])
            alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
        for t in range(width - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], (beta[:, t + 1] * local[:, t + 1]) @ step.T, 1.0)
            beta[:, t] /= beta[:, t].sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        pair = alpha[:, :-1, :, None] * step[None, None] * (local[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        both = live[:, 1:] & live[:, :-1]
        true_pair = np.zeros((2, 2))
        np.add.at(true_pair, (tags[:, :-1][both], tags[:, 1:][both]), 1)
        grad = np.zeros_like(theta)
        np.add.at(grad, f[live], (tags - post[:, :, 1])[live])
        grad[size] = (tags[:, 0] - post[:, 0, 1]).sum()
        grad[size + 1:] = (true_pair - pair[both].sum(0)).ravel()
        grad = grad / count - penalty * theta / max(1.0, math.log(count + 1)) / 10
        seen += grad ** 2
        theta += 0.7 * grad / (np.sqrt(seen) + 1e-12)
    model.emission, model.start, model.change = theta[:size], float(theta[size]), theta[size + 1:].reshape(2, 2)


def fit_curve(points: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on the two document figures (Newton steps)."""
    x = np.column_stack([np.ones(len(points)), points])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(3)
        w += np.linalg.solve(hessian, x.T @ (labels - p) - 1e-2 * w)
    return tuple(float(v) for v in w)


def fit(rows: list[tuple[list[str], int]]) -> Model:
    """A model from (words, label) rows."""
    model = Model()
    toxic, clean = ([set(w) for w, y in rows if y == k] for k in (1, 0))
    if not toxic or not clean:
        return model
    model.lexicon = {w: i for i, w in enumerate(choose_lexicon(toxic, clean), 1)}
    model.emission = np.zeros(len(model.lexicon) + 1)
    model.emission[0] = -2.0
    model.start = -2.0
    feature = WordFeatures(model.lexicon)
    encoded = [(np.array([feature[x] for x in w], dtype=np.int64), y) for w, y in rows]
    fit_weights(model, *_windows(encoded))
    points = np.array([evidence(marginals(model, f)) for f, _ in encoded])
    model.curve = fit_curve(points, np.array([y for _, y in rows], dtype=float))
    return model


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1000) -> Model:
    """Fit on a sample of the labelled rows that aren't held out: ids are drawn by their hash,
    about per_class of each label; their words come to the driver."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~is_held_out(5, 0))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not all(sizes.get(k) for k in (0, 1)):
        return Model()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("label") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    drawn = known.where(F.col("label").isin(0, 1) & (draw < share))
    # about 2 * per_class rows of two numbers: small by construction
    # of the texts of a repeated id the first in order is learned from
    sample = id_text(docs).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def words(batches):
        for batch in batches:
            found = [WORD.findall(t.lower()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.string()))],
                                             ["doc_id", "label", "words"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(words, "doc_id long, label int, words array<string>").collect()
    return fit([([sys.intern(w) for w in r["words"]], r["label"]) for r in sorted(rows, key=lambda r: r["doc_id"])])


class Scorer:
    """Scores and offending offsets of texts, in one task."""

    def __init__(self, model: Model):
        self.model = model
        self.feature = WordFeatures(model.lexicon).__getitem__
        self.quiet: dict[int, float] = {}  # score of a text without lexicon words, by its number of words
        self.forward = self.backward = np.zeros((0, 2))

    def quiet_score(self, n: int) -> float:
        """The score of n words that are in no lexicon entry. All their factors are equal, so the
        forward and backward vectors of the longest such text hold those of all shorter ones."""
        if n not in self.quiet:
            if n > len(self.forward):
                size = max(1024, 1 << n.bit_length())
                local = np.array([1.0, math.exp(self.model.emission[0])])
                inner = np.repeat((np.exp(self.model.change) * local)[None], size, axis=0)
                first = inner.copy()
                first[0] = np.array([[1.0, math.exp(self.model.start)]] * 2) * local
                self.forward = _scan(first)[:, 0, :]
                self.backward = np.concatenate([np.ones((1, 2)), _scan(inner.transpose(0, 2, 1)).sum(axis=1)[:-1]])
            joint = self.forward[:n] * self.backward[:n][::-1]
            self.quiet[n] = document_score(self.model, joint[:, 1] / joint.sum(axis=1))
        return self.quiet[n]

    def row(self, text: str | None) -> tuple[float, list[dict[str, int]]]:
        text = text or ""
        lower = text.lower()
        features = list(map(self.feature, WORD.findall(lower)))
        if not any(features):
            return self.quiet_score(len(features)), []
        p = marginals(self.model, np.array(features, dtype=np.int64))
        # a letter whose lower case is longer moves the offsets: they then count in the lower-cased text
        places = [m.span() for m in WORD.finditer(lower)]
        spans, last = [], -2
        for i in np.flatnonzero(p >= 0.5).tolist():
            if i == last + 1:
                spans[-1]["stop"] = places[i][1]
            else:
                spans.append({"start": places[i][0], "stop": places[i][1]})
            last = i
        return document_score(self.model, p), spans


SCHEMA = "doc_id long, score double, predicted int, spans array<struct<start:int,stop:int>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, spans): spans are code-point offsets of toxic word runs."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def make():
        scorer = Scorer(model)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scorer.row(t) for t in part.column("text").to_pylist()]
            scores = [s for s, _ in rows]
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                 pa.array([x for _, x in rows], spans_type)], ["doc_id", "score", "predicted", "spans"])

        return one

    return map_slices(id_text(docs), make, SCHEMA)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, unchanged, whose text isn't predicted toxic."""

    def make():
        scorer = Scorer(model)
        return lambda part: part.filter(pa.array([scorer.row(t)[0] < 0.5 for t in part.column("text").to_pylist()], pa.bool_()))

    return map_slices(docs, make, docs.schema)


def tag(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, score every row."""
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", F.coalesce(is_held_out(5, 0), F.lit(False)).alias("held_out"), "score", "predicted", "spans")
