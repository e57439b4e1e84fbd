"""Quality: learned vectors of hashed words and character n-grams, averaged per document, with a softmax output."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wavespan.llm.common import arrow_steps, id_and_text, labelled_sample, strings

BUCKETS, DIMENSIONS = 1 << 16, 8
GRAMS = (2, 3, 4)
#: Bound of the training sample.
SAMPLE_ROWS = 3000
EPOCHS, RATE = 12, 0.5
THRESHOLD = 0.3
CACHE = 400_000
STEP_CHARS = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' subwords, where each word's begin): ``<word>`` itself and its character n-grams."""
    marked = "".join([f"<{w}>" for w in words])
    chars = np.frombuffer(marked.encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    hashed = np.zeros(len(chars), np.uint64)
    parts, owners = [], []
    with np.errstate(over="ignore"):
        power = np.ones(int(lengths.max(initial=1)) + 1, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(len(power) - 1, np.uint64(1_000_003)))
        place = (np.arange(len(chars)) - np.repeat(start, lengths)).astype(np.int64)
        whole = np.add.reduceat(chars * power[place], start) if len(words) else np.zeros(0, np.uint64)
        parts.append(((whole ^ (whole >> np.uint64(29))) * _MIX) >> np.uint64(48))
        owners.append(np.arange(len(words)))
        for n in range(1, max(GRAMS) + 1):
            hashed[: len(chars) - n + 1] = hashed[: len(chars) - n + 1] * np.uint64(1_000_003) + chars[n - 1 :]
            if n in GRAMS:
                inside = place + n <= np.repeat(lengths, lengths)
                h = hashed[inside] + np.uint64(n)
                parts.append(((h ^ (h >> np.uint64(31))) * _MIX) >> np.uint64(48))
                owners.append(owner[inside])
    bucket, by = np.concatenate(parts).astype(np.int64) % BUCKETS, np.concatenate(owners)
    order = np.argsort(by, kind="stable")
    return bucket[order], np.concatenate(([0], np.cumsum(np.bincount(by, minlength=len(words)))))


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All texts' words, letter case kept, and where each text's words begin."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    flat, at = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    full = pc.not_equal(flat, "")
    if not pc.all(full).as_py():
        kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
        flat, at = flat.filter(full), kept[at]
    return flat, at


#: A word of its own beside each word that is equal to the one before it, whose vectors count too.
AGAIN = "\x01"


def coded_words(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of each word, the distinct words, where each text's words begin), with AGAIN after repeated words."""
    flat, at = words_of(texts)
    coded = flat.dictionary_encode()
    number, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    same = np.zeros(len(number), bool)
    same[1:] = number[1:] == number[:-1]
    same[at[:-1][at[:-1] < len(number)]] = False
    again = np.flatnonzero(same)
    return np.insert(number, again + 1, len(distinct)), [*distinct, AGAIN], at + np.searchsorted(again, at)


@dataclass
class SubwordModel:
    """Probability of label 1 = softmax of the mean subword vector times the output weights."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    cache: dict[str, tuple[float, int]] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def scores(self, texts: list[str]) -> np.ndarray:
        """The mean is linear in the words, so a word's part of the margin is worked out once."""
        number, distinct, at = coded_words(texts)
        new = [w for w in distinct if w not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = distinct
        if new:
            margin = (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(float)
            bucket, start = subwords(new)
            sums = np.add.reduceat(margin[bucket], start[:-1])
            self.cache.update(zip(new, zip(sums.tolist(), np.diff(start).tolist(), strict=True), strict=True))
        value, size = np.array([self.cache[w] for w in distinct]).T if distinct else (np.zeros(0), np.zeros(0))
        total, count = (np.add.reduceat(np.append(v[number], 0), at[:-1]) * (np.diff(at) > 0) for v in (value, size))
        z = float(self.bias[1] - self.bias[0]) + total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its subwords' buckets and their share of all its subwords."""
    number, distinct, at = coded_words(texts)
    bucket, start = subwords(distinct)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        word, n = np.unique(number[a:b], return_counts=True)
        size = start[word + 1] - start[word] if len(word) else np.zeros(0, int)
        place = np.repeat(start[word] - np.cumsum(size) + size, size) + np.arange(size.sum()) if len(word) else np.zeros(0, int)
        own, again = np.unique(bucket[place], return_inverse=True)
        weight = np.bincount(again, np.repeat(n, size), len(own))
        out.append((own, weight / max(weight.sum(), 1)))
    return out


def train_model(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> SubwordModel:
    """Stochastic gradient descent, a document at a time; without labels of both kinds, their smoothed share."""
    rng = np.random.default_rng(1)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    output = np.zeros((DIMENSIONS, 2))
    share = (label.sum() + 1) / (len(label) + 2)
    bias = np.log([1 - share, share])
    if 0 < label.sum() < len(label):
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for k in rng.permutation(len(rows)).tolist():
                bucket, weight = rows[k]
                if not len(bucket):
                    continue
                mean = weight @ vectors[bucket]
                z = mean @ output + bias
                p = np.exp(z - z.max())
                error = p / p.sum()
                error[label[k]] -= 1
                back = output @ error
                output -= rate * np.outer(mean, error)
                bias -= 0.1 * rate * error
                vectors[bucket] -= (rate * len(bucket) ** 0.5 * weight[:, None] * back).astype(np.float32)
    return SubwordModel(vectors, output, bias)


def fit(docs: DataFrame, labels: DataFrame, train, rows: int = SAMPLE_ROWS) -> SubwordModel:
    """Learns ``labels.quality`` from at most ``rows`` of the labelled documents that ``train`` admits."""

    def found(batches):
        for batch in batches:
            got = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([b.astype("<u2").tobytes() for b, _ in got], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in got], pa.binary())], names=["label", "bucket", "weight"])

    sample = labelled_sample(docs, labels, "quality", train, rows).select("label", "text").mapInArrow(found, "label int, bucket binary, weight binary").collect()
    sample.sort(key=lambda r: (bytes(r[1]), bytes(r[2]), r[0]))  # the same model however the rows arrive
    return train_model([(np.frombuffer(r[1], "<u2").astype(np.int64), np.frombuffer(r[2], "<f4")) for r in sample], np.array([r[0] for r in sample], int))


def quality(docs: DataFrame, labels: DataFrame, train) -> DataFrame:
    """(doc_id, score) for every row, from its whole text alone; a text without words has the score of the bias.

    Equal texts, also repeated rows, have equal scores up to rounding; a text of any length is scored whole. Null
    labels are left out; without labels of both kinds every score is their smoothed share. An empty table gives an
    empty result.
    """
    model = fit(docs, labels, train)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a, b in arrow_steps(texts, STEP_CHARS):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(model.scores(strings(texts, a, b)))], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")
