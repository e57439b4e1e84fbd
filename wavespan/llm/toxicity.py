"""Toxicity: a factorization machine over hashed terms, trained here on a bounded sample of labelled rows."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wavespan.llm.common import arrow_steps, id_and_text, id_text_steps, labelled_sample, ship, strings

BUCKETS = 1 << 20
#: Besides itself a term counts as its beginnings of so many characters, which its inflections share.
BEGINNINGS = (4, 5, 6, 7)
CACHE = 400_000
#: Bound of the training sample.
SAMPLE_ROWS, FACTORS = 6000, 8
#: Training: passes, rows of a step, the weights' rate and their L1 and L2 penalties, the factors' rate and penalty.
EPOCHS, BATCH = 20, 32
RATE, SPARSE, RIDGE = 0.2, 8.0, 0.1
FACTOR_RATE, FACTOR_DECAY = 0.05, 0.01
#: A missed positive costs so many times a false one.
POSITIVE = 2.5
THRESHOLD = 0.3

#: ASCII letters in lower case, digits and bytes beyond ASCII stay; the rest parts terms.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def words_of(text: str) -> set[bytes]:
    return set(text.encode("utf-8").translate(_TERM_BYTES).split())


def buckets(word: bytes) -> list[int]:
    chars = word.decode("utf-8", "replace")
    return [zlib.crc32(word) % BUCKETS, *[zlib.crc32(b"^" + chars[:n].encode("utf-8", "replace")) % BUCKETS for n in BEGINNINGS if n < len(chars)]]


def terms(text: str) -> set[int]:
    """Buckets of the text's distinct terms."""
    return {b for word in words_of(text) for b in buckets(word)}


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of weights + sum over pairs of terms of the product of their factors)."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        self.place = {t: k for k, t in enumerate(self.terms.tolist())}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def score(self, text: str) -> float:
        words, known, place = words_of(text), self.known, self.place
        if new := words.difference(known):
            if len(known) + len(new) > CACHE:
                known.clear()
                new = words
            for w in new:
                known[w] = tuple(place[b] for b in buckets(w) if b in place)
        own = sorted(set().union(*map(known.__getitem__, words)))
        total = self.factors[own].sum(axis=0)
        z = self.bias + self.weights[own].sum() + 0.5 * float((total**2 - (self.factors[own] ** 2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train_machine(found: list[np.ndarray], label: np.ndarray) -> FactorizationMachine:
    """Learns from rows of distinct buckets: weights by FTRL-proximal steps, factors by AdaGrad steps.

    Every bucket of the sample takes part. The L1 penalty leaves most weights at zero; a bucket's factors are
    learned while its weight isn't, as in adaptive factorization machines. What stays at zero is not stored. Without
    rows of both labels the machine says the smoothed share of label 1.
    """
    label = np.asarray(label, float)
    share = (label.sum() + 0.5) / (len(label) + 20)
    bias, seen = float(np.log(share / (1 - share))), np.unique(np.concatenate([*found, []])).astype(int)
    rng = np.random.default_rng(1)
    weights, factors = np.zeros(len(seen)), rng.normal(0, 0.02, (len(seen), FACTORS))
    if 0 < label.sum() < len(label):
        rows = [np.searchsorted(seen, f) for f in found]
        lean, steep, steep_factors, steep_bias = np.zeros(len(seen)), np.zeros(len(seen)), np.ones_like(factors), 1.0
        by = lambda at, values, n: np.stack([np.bincount(at, values[:, k], n) for k in range(FACTORS)], axis=1)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                n, term = len(some), np.concatenate([rows[i] for i in some])
                row = np.repeat(np.arange(n), [len(rows[i]) for i in some])
                live = weights[term] != 0
                term_live, row_live = term[live], row[live]
                own = factors[term_live]
                total = by(row_live, own, n)
                z = bias + np.bincount(row, weights[term], n) + 0.5 * ((total**2).sum(axis=1) - np.bincount(row_live, (own**2).sum(axis=1), n))
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]) * np.where(label[some] > 0, POSITIVE, 1)
                at, place = np.unique(term, return_inverse=True)
                slope = np.bincount(place, error[row], len(at))
                lean[at] += slope - (np.sqrt(steep[at] + slope**2) - np.sqrt(steep[at])) / RATE * weights[at]
                steep[at] += slope**2
                weights[at] = np.where(np.abs(lean[at]) <= SPARSE, 0.0, (np.sign(lean[at]) * SPARSE - lean[at]) / ((1 + np.sqrt(steep[at])) / RATE + RIDGE))
                if len(term_live):
                    at, place = np.unique(term_live, return_inverse=True)
                    slope = by(place, error[row_live, None] * (total[row_live] - own), len(at)) + FACTOR_DECAY * factors[at]
                    steep_factors[at] += slope**2
                    factors[at] -= FACTOR_RATE * slope / np.sqrt(steep_factors[at])
                steep_bias += error.sum() ** 2
                bias -= 0.1 * error.sum() / np.sqrt(steep_bias)
    kept = weights != 0
    return FactorizationMachine(seen[kept], float(bias), weights[kept], factors[kept])


def fit(docs: DataFrame, labels: DataFrame, train, rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Learns ``labels.toxic`` from at most ``rows`` of the labelled documents that ``train`` admits."""

    def found(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in arrow_steps(texts):
                got = [np.array(sorted(terms(t)), "<u4").tobytes() for t in strings(texts, a, b)]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(got, pa.binary())], names=["label", "terms"])

    sample = labelled_sample(docs, labels, "toxic", train, rows).select("label", "text").mapInArrow(found, "label int, terms binary").collect()
    sample.sort(key=lambda r: (bytes(r[1]), r[0]))  # the same model however the rows arrive
    return train_machine([np.frombuffer(r[1], "<u4").astype(int) for r in sample], np.array([r[0] for r in sample]))


def toxicity(docs: DataFrame, labels: DataFrame, train) -> DataFrame:
    """(doc_id, score) for every row, from its whole text alone. A null or empty text has the score of no terms.

    Equal texts, also repeated rows, have equal scores; a text of any length is scored whole. Labels that are null or
    have no document are left out; without labels of both kinds every score is the smoothed share of label 1. An
    empty table gives an empty result.
    """
    machine = fit(docs, labels, train)

    def run(batches):
        for ids, texts in id_text_steps(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([machine.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, verdicts) -> DataFrame:
    """The rows of docs, with docs' columns, that ``verdicts`` admits by their texts, in one pass over the table.

    A null text counts as empty.
    """

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for a, b in arrow_steps(texts):
                yield batch.slice(a, b - a).filter(pa.array(verdicts(strings(texts, a, b)), pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
