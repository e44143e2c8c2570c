"""Toxicity by multiple-instance learning: sentences judged, documents labelled.

A sentence's probability is logistic in its words and their beginnings; a document is
toxic unless all of its sentences are harmless (noisy-or). The weights are fitted to
document labels by gradient descent through the noisy-or, so sentence scores are
learned without sentence labels and locate what offends.

The model is fitted on a sample of labelled documents that one task can hold
(``SAMPLE_DOCS`` and ``SAMPLE_CHARS`` expected at most, chosen by hashes of doc_id);
scoring covers every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from quern.storage import Scratch

#: Labelled documents that the model is fitted on, in expectation.
SAMPLE_DOCS = 12_000
#: Characters of them at most, in expectation.
SAMPLE_CHARS = 60_000_000
#: Features of the model at most: those with the strongest association.
MAX_FEATURES = 50_000
THRESHOLD = 0.3
STEPS, RATE, SHRINK = 250, 0.1, 3e-6
_CACHE = 400_000  # words whose weight a worker remembers

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_BREAKS = frozenset(".!?\n")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> list[str]:
    """The word and its beginnings of 4, 5 and 6 letters."""
    return [word, *(f"{word[:n]}~" for n in (4, 5, 6) if len(word) >= n)]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Bags:
    """Labelled documents as bags of sentences, for the noisy-or.

    ``index`` and ``sentence_of`` say which feature occurs in which sentence, once for
    each occurrence; ``doc_of`` says which document a sentence belongs to, in order.
    """

    def __init__(self, index: np.ndarray, sentence_of: np.ndarray, doc_of: np.ndarray, labels: np.ndarray):
        self.index, self.sentence_of, self.n, self.docs = index, sentence_of, len(doc_of), len(labels)
        filled = np.unique(doc_of)  # documents without words tell nothing
        self.starts = np.searchsorted(doc_of, filled)
        self.truth, self.position = labels[filled], np.searchsorted(filled, doc_of)

    def noisy_or(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of sentences, and log(1 - P) of documents."""
        z = w[-1] + np.bincount(self.sentence_of, w[self.index], minlength=self.n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p, np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), self.starts) if self.n else np.zeros(0)

    def loss(self, w: np.ndarray) -> float:
        """Cross-entropy of the document labels, a mean over all documents, and the shrinkage."""
        _, clean = self.noisy_or(w)
        likely = np.where(self.truth == 1, np.log(np.maximum(-np.expm1(clean), 1e-300)), clean)
        return float(-likely.sum() / self.docs + SHRINK / 2 * (w[:-1] ** 2).sum())

    def gradient(self, w: np.ndarray) -> np.ndarray:
        p, log_clean = self.noisy_or(w)
        clean = np.exp(log_clean)
        pull = np.where(self.truth == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        g = pull[self.position] * p / self.docs
        grad = np.bincount(self.index, g[self.sentence_of], minlength=len(w)) + SHRINK * w
        grad[-1] = g.sum()
        return grad


def fit(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Weights by feature, '' for the bias. Needs both classes; else only a bias."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return {"": 30.0 if len(y) and y.min() == 1 else -30.0}
    bags: list[list[list[str]]] = []
    frequency = (Counter(), Counter())
    same: dict[str, str] = {}  # one object for each word
    for text, label in zip(texts, labels, strict=True):
        sentences, now = [], []
        for token in _TOKEN.findall((text or "").lower()):
            if token in _BREAKS:
                if now:
                    sentences.append(now)
                now = []
            else:
                now.append(same.setdefault(token, token))
        sentences += [now] if now else []
        bags.append(sentences)
        frequency[int(label)].update({f for w in {w for s in sentences for w in s} for f in features(w)})
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    strong = {}
    for f, ones in frequency[1].items():
        zeros = frequency[0][f]
        odds = np.log((ones + 0.5) / (n1 + 1)) - np.log((zeros + 0.5) / (n0 + 1))
        if ones >= 3 and odds > 1:
            strong[f] = odds * ones
    vocabulary = {f: i for i, f in enumerate(sorted(strong, key=lambda f: (-strong[f], f))[:MAX_FEATURES])}

    index, sentence_of, doc_of, n = [], [], [], 0
    known: dict[str, list[int]] = {}
    for d, sentences in enumerate(bags):
        for words in sentences:
            for w in words:
                found = known.get(w)
                if found is None:
                    found = known[w] = [vocabulary[f] for f in features(w) if f in vocabulary]
                index += found
                sentence_of += [n] * len(found)
            doc_of.append(d)
            n += 1
    bags.clear()
    data = Bags(np.array(index, np.int64), np.array(sentence_of, np.int64), np.array(doc_of, np.int64), y)
    w = np.zeros(len(vocabulary) + 1)  # the bias is last
    w[-1] = -8.0
    mean, square = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, STEPS + 1):
        grad = data.gradient(w)
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad**2 - square)
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-10)
    return {"": float(w[-1])} | {f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 1e-3}


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [*batches]
    rows = pd.concat(frames).sort_values(["doc_id", "toxic", "text"]) if frames else pd.DataFrame({"text": [], "toxic": []})
    weights = fit(rows["text"].tolist(), rows["toxic"].tolist())
    yield pd.DataFrame({"feature": [*weights], "weight": [*weights.values()]})


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, float]:
    """Fit on a sample of labelled rows that are not held out. Null ids, texts and labels are left out.

    The sample is chosen by hashes of doc_id: ``sample_docs`` labels, of these at most
    ``sample_chars`` characters, both in expectation. Repeated rows count again.
    """
    marks = (
        labels.select("doc_id", "toxic")
        .where("doc_id is not null and toxic in (0, 1)")
        .where(~is_held_out(F.col("doc_id")))
    )
    total = marks.count()

    def unit(salt: str) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)

    marks = marks.where(unit("toxicity") < min(1.0, sample_docs / max(total, 1)))
    rows = docs.where("text is not null").select("doc_id", "text").join(marks.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "toxic")
    rows = scratch.save(rows, "sample")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if chars > sample_chars:
        rows = rows.where(unit("characters") < sample_chars / chars)
    model = scratch.save(rows.repartition(1).mapInPandas(_fitted, "feature string, weight double"), "model")
    weights = {r["feature"]: r["weight"] for r in model.collect()}  # MAX_FEATURES and a bias at most
    scratch.drop("sample", "model")
    return weights


class Scorer:
    """Applies weights to whole texts; remembers the weight of frequent words."""

    def __init__(self, weights: dict[str, float]):
        self.bias = weights.get("", -30.0)
        self.weights = {k: v for k, v in weights.items() if k}
        self.words: dict[str, float | None] = dict.fromkeys(_BREAKS)

    def weigh(self, word: str) -> float:
        if len(self.words) > _CACHE:
            self.words = dict.fromkeys(_BREAKS)
        get = self.weights.get
        total = self.words[word] = sum(get(f, 0.0) for f in features(word))
        return total

    def log_odds(self, text: str) -> list[float]:
        """Of each sentence that has words, in order."""
        out, now, any_ = [], self.bias, False
        for token in _TOKEN.findall(text.lower()):
            try:
                v = self.words[token]
            except KeyError:
                v = self.weigh(token)
            if v is None:
                if any_:
                    out.append(now)
                now, any_ = self.bias, False
            else:
                now += v
                any_ = True
        if any_:
            out.append(now)
        return out

    def score(self, text: str | None) -> float:
        z = np.array(self.log_odds(text or ""))
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0

    def offending(self, text: str, threshold: float) -> list[dict]:
        """start, end (code points) and score of the sentences at or over the threshold."""
        found = []
        for m in _SENTENCE.finditer(text):
            score = self.score(m[0])
            if score >= threshold:
                found.append({"start": m.start(), "end": m.end(), "score": score})
        return found


SCORED = "score double, predicted int, offending array<struct<start:int,end:int,score:double>>"


def score_documents(docs: DataFrame, weights: dict[str, float], threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus score, predicted and, where predicted, offending sentences.

    Null, empty and wordless texts score 0. Only ``text`` enters the score, so equal
    texts score alike. Columns already called like a result are replaced.
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(weights)
        for batch in texts:
            scores = [scorer.score(t) for t in batch]
            yield pd.DataFrame(
                {
                    "score": scores,
                    "predicted": [int(s >= threshold) for s in scores],
                    "offending": [scorer.offending(t, threshold) if s >= threshold else [] for t, s in zip(batch, scores, strict=True)],
                }
            )

    judge = F.pandas_udf(run, SCORED, PandasUDFType.SCALAR_ITER)
    kept = [c for c in docs.columns if c not in {"score", "predicted", "offending"}]
    return docs.select(*kept, judge("text").alias("_q")).select(*kept, "_q.score", "_q.predicted", "_q.offending")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``score_documents`` with a model fitted on ``labels`` (doc_id, toxic).

    Without labels of both classes every document scores by the bias alone. Empty
    tables give empty results.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    return score_documents(docs, train(docs, labels, scratch, sample_docs), threshold)
