"""Quality rules: statistics of whole texts, and an isolation forest over them calibrated on labelled rows."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.llm.common import id_and_text, id_text_steps, least_hashes, materialize

WINDOW = 5
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: The forest: trees, and rows that each tree splits (the method's subsample), other rows for each tree if there are enough.
TREES, SUBSAMPLE = 100, 256
#: Bound of the labelled rows that choose the forest's ratios, and trees of the forests that are compared for it.
LABELLED, TRIAL_TREES = 4000, 20
#: The threshold where labels don't give one.
UNLABELLED = 0.7
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["distinct_words", "upper_chars", "punctuation", "digits", "n_lines", "n_chars", "same_as_last"]
PUNCTUATION = "!?.,;:'\"()-"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows that are found twice or more, the first included. Hashes find them, the words decide."""
    if len(words) <= width:
        return 0
    numbers = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(words) - width + 1
    hashed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (numbers + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for k in range(width):
            hashed = hashed * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    if not same.any():
        return 0
    maybe = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    windows = [tuple(words[k : k + width]) for k in maybe.tolist()]
    often = Counter(windows)
    mark = np.zeros(len(words) + 1, np.int64)
    for k, w in zip(maybe.tolist(), windows, strict=True):
        if often[w] > 1:
            mark[k] += 1
            mark[min(k + width, len(words))] -= 1
    return int((np.cumsum(mark[:-1]) > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    """BASE and MORE of one text."""
    raw = text.encode("utf-8")
    words = raw.split()
    lines = text.split("\n")
    full = [x for x in lines if x.strip(WHITE)]
    spaces = sum(map(text.count, WHITE))
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    upper = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(full) - len(set(full)), repeated_words(words),
        len(set(words)), upper, sum(map(text.count, PUNCTUATION)), sum(map(text.count, "0123456789")), len(lines), len(text), same,
    )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, BASE..., MORE...) for every row; of a null or empty text all are 0 but n_lines, which is 1."""
    names = BASE + MORE

    def run(batches):
        for ids, texts in id_text_steps(batches):
            columns = zip(*map(statistics, texts), strict=True)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", *names])

    return id_and_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def shapes(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios of the statistics, that do not grow with a text."""
    r = {k: v.astype(float) for k, v in rows.items()}
    words, chars, lines = np.maximum(r["n_words"], 1), np.maximum(r["word_chars"], 1), np.maximum(r["n_lines"], 1)
    return np.column_stack([
        np.minimum(r["word_chars"] / words, 60), r["n_symbols"] / chars, r["n_dup_lines"] / lines, r["n_repeat_words"] / words,
        r["upper_chars"] / chars, r["punctuation"] / chars, r["digits"] / chars, r["same_as_last"] / words,
    ])


def mean_path(n):
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as arrays: feature (-1: leaf), split value, children; at leaves the path length to add."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    length: np.ndarray
    rows: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / mean path of the subsample): near 1 for rows that random splits soon isolate."""
        total = np.zeros(len(x))
        for f, s, child, length in zip(self.feature, self.split, self.left, self.length, strict=True):
            at = np.zeros(len(x), int)
            while (inner := f[at] >= 0).any():
                own = np.flatnonzero(inner)
                k = at[own]
                at[own] = child[k] + (x[own, f[k]] >= s[k])
            total += length[at]
        return 2 ** (-total / len(self.feature) / max(float(mean_path(self.rows)), 1e-9)) if len(self.feature) else np.full(len(x), 0.5)


def grow(pool: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE) -> IsolationForest:
    """Each tree splits its rows at random values of random features that still differ, down to single rows.

    A pool of ``trees`` times ``subsample`` rows or more gives each tree rows of its own.
    """
    rng = np.random.default_rng(1)
    size = min(subsample, len(pool))
    limit, nodes = int(np.ceil(np.log2(max(size, 2)))), 4 * max(size, 1)
    feature, split = np.full((trees, nodes), -1), np.zeros((trees, nodes))
    left, length = np.zeros((trees, nodes), int), np.zeros((trees, nodes))
    dealt = rng.permutation(len(pool))
    for t in range(trees if size else 0):
        own = dealt[t * size : (t + 1) * size] if trees * size <= len(pool) else rng.choice(len(pool), size, replace=False)
        todo, used = [(0, pool[own], 0)], 1
        while todo:
            node, rows, depth = todo.pop()
            lo, hi = rows.min(axis=0), rows.max(axis=0)
            differ = np.flatnonzero(hi > lo)
            if depth >= limit or not len(differ):
                length[t, node] = depth + mean_path(len(rows))
                continue
            f = differ[rng.integers(len(differ))]
            value = rng.uniform(lo[f], hi[f])
            value = value if value > lo[f] else hi[f]
            right = rows[:, f] >= value
            feature[t, node], split[t, node], left[t, node] = f, value, used
            todo += [(used, rows[~right], depth + 1), (used + 1, rows[right], depth + 1)]
            used += 2
    kept = slice(trees if size else 0)
    return IsolationForest(feature[kept], split[kept], left[kept], length[kept], size)


def best_threshold(steps: list[tuple[int, int, int]]) -> tuple[float, int]:
    """From (thousandth of the score, good rows, bad rows): the threshold with the fewest good rows over it and bad
    rows up to it, and how many these are; of equal ones the highest. Both kinds are needed."""
    good, bad = sum(g for _, g, _ in steps), sum(b for _, _, b in steps)
    if not good or not bad:
        return UNLABELLED, 0
    least, threshold, good_over, bad_under = good + bad, UNLABELLED, good, 0
    for step, g, b in sorted(steps):
        good_over, bad_under = good_over - g, bad_under + b
        if good_over + bad_under <= least:
            least, threshold = good_over + bad_under, step / 1000
    return threshold, least


def thousandths(score: np.ndarray, quality: np.ndarray) -> list[tuple[int, int, int]]:
    """(thousandth, good rows, bad rows) for ``best_threshold``."""
    step, place = np.unique(np.ceil(score * 1000).astype(int), return_inverse=True)
    good = np.bincount(place, quality, len(step)).astype(int)
    return list(zip(step.tolist(), good.tolist(), (np.bincount(place, minlength=len(step)) - good).tolist(), strict=True))


def chosen(pool: np.ndarray, labelled: np.ndarray, quality: np.ndarray) -> list[int]:
    """The ratios with which a forest tells labelled rows apart: one after another, the one that leaves fewest on the
    wrong side of the best threshold, until none leaves fewer. Without rows of both labels all ratios."""
    every = list(range(pool.shape[1]))
    if not len(pool) or len(np.unique(quality)) < 2:
        return every
    own, least = [], min((quality == 0).sum(), (quality == 1).sum())
    while len(own) < len(every):
        tried = [(best_threshold(thousandths(grow(pool[:, own + [k]], TRIAL_TREES).score(labelled[:, own + [k]]), quality))[1], k) for k in every if k not in own]
        if min(tried)[0] >= least:
            break
        least, best = min(tried)
        own.append(best)
    return own or every


def forest_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, BASE..., base_failed, score, kept) for every row.

    Rows that fail the base rules are not kept. The others are kept unless the forest's score is over a threshold.
    Labels calibrate both: at most LABELLED labelled rows choose the ratios that the forest splits, and the threshold
    is, of a thousand, the one that puts fewest of all labelled rows on the wrong side. Where a doc_id has several
    labels, the largest counts, and each of its rows. Without rows of both labels all ratios and 0.7 count. A tree's
    rows are drawn from all rows that pass the base rules, by a hash of doc_id. Null and empty texts fail; a text of
    any length is measured whole; equal texts have equal verdicts; an empty table gives an empty result.
    """
    table = materialize(rule_statistics(docs).withColumn("base_failed", base_failed()), "rules-statistics")
    names = BASE + MORE
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    passing = table.filter("not base_failed").drop("base_failed")
    ratios = lambda df: shapes({n: df[n].to_numpy() for n in names})
    pool = ratios(least_hashes(passing, F.xxhash64("doc_id"), TREES * SUBSAMPLE).toPandas())
    some = least_hashes(passing.join(known, "doc_id"), F.xxhash64("doc_id"), LABELLED).toPandas()
    own = chosen(pool, ratios(some), some["quality"].to_numpy())
    forest = grow(pool[:, own])

    def run(batches):
        for batch in batches:
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("doc_id", *BASE, "base_failed")], pa.array(forest.score(shapes(rows)[:, own]))], names=["doc_id", *BASE, "base_failed", "score"])

    scored = table.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, score double")
    steps_of = scored.filter("not base_failed").join(known, "doc_id").groupBy(F.ceil(F.col("score") * 1000).alias("step")).agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    threshold, _ = best_threshold([tuple(r) for r in steps_of.collect()])
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") <= F.lit(threshold)))
