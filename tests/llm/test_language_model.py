"""The language model against a sampler that moves one customer at a time, and against its own laws."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavespan.llm import pitman_yor
from wavespan.llm.pitman_yor import STRENGTH, Model, Seating


class OneByOne:
    """Restaurants of contexts over a parent; every customer leaves and sits down again, in turn, with all counts as they are."""

    def __init__(self, pairs, discount, parent_discount, vocabulary, rng):
        self.rng, self.discounts, self.base = rng, {True: parent_discount, False: discount}, 1 / (vocabulary + 1)
        self.tables = defaultdict(lambda: defaultdict(list))  # restaurant -> dish -> sizes
        self.pairs = pairs
        for c, w in pairs:
            self.sit(c, w)

    def seated(self, at):
        return sum(map(sum, self.tables[at].values())), sum(map(len, self.tables[at].values()))

    def probability(self, at, w):
        d, above = self.discounts[at is None], self.base if at is None else self.probability(None, w)
        n, t = self.seated(at)
        own = self.tables[at][w]
        return (sum(own) - d * len(own) + (STRENGTH + d * t) * above) / (STRENGTH + n)

    def sit(self, at, w):
        d, own = self.discounts[at is None], self.tables[at][w]
        above = self.base if at is None else self.probability(None, w)
        weight = np.array([k - d for k in own] + [(STRENGTH + d * self.seated(at)[1]) * above])
        k = int(self.rng.choice(len(weight), p=weight / weight.sum()))
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            if at is not None:
                self.sit(None, w)

    def leave(self, at, w):
        own = self.tables[at][w]
        k = int(self.rng.choice(len(own), p=np.array(own) / sum(own)))
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            if at is not None:
                self.leave(None, w)

    def sweep(self):
        for c, w in self.pairs:
            self.leave(c, w)
            self.sit(c, w)


def test_scores_are_those_of_a_sampler_customer_by_customer(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"], 7, p=[0.4, 0.3, 0.15, 0.1, 0.05])) for _ in range(12)] + ["a b a b a b", "a b c zz", "zz a a", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pitman_yor.score_texts(rows, F.col("doc_id") < 12, chain=(3, 12)).toPandas().set_index("doc_id")
    sequence = lambda t: list(zip(["<"] + t.split(), t.split() + [">"], strict=True))
    pairs = [p for t in texts[:12] for p in sequence(t)]
    ones = lambda counts: (counts.count(1), counts.count(2))
    discount = pitman_yor._estimated(*ones(list(Counter(pairs).values())))
    contexts = Counter(w for _, w in set(pairs))
    slow = OneByOne(pairs, discount, pitman_yor._estimated(*ones(list(contexts.values()))), len(contexts), rng)
    asked, mean, kept = sorted({p for t in texts for p in sequence(t)}), Counter(), 250
    for k in range(kept + 30):
        slow.sweep()
        if k >= 30:
            for c, w in asked:
                mean[c, w] += slow.probability(c, w) / kept
    want = [sum(math.log10(mean[p]) for p in sequence(t)) for t in texts]
    assert np.abs(got["score"].sort_index().to_numpy() - want).max() < 0.12


def test_probabilities_add_up():
    """Of the parent, over all words and an unseen one; of a context restaurant that backs off to it."""
    customers, tables = np.array([5.0, 3, 1, 1, 0]), np.array([2.0, 1, 1, 1, 0])
    model = Model(0.6, 0.4, 4, customers.sum(), tables.sum())
    parent = model.parent(customers, tables)
    assert parent.sum() == pytest.approx(1)
    unit = pitman_yor.Unit(pitman_yor._put(*(np.array(x, t) for x, t in (([7], "<i8"), ([6], "<u8"), ([1, 1, 1, 1, 1], "<i8"), ([0] * 5, "<u4"), (range(5), "<u4"), ([4, 0, 2, 0, 0], "<u8"), ([9], "<u8")))))
    seats = np.array([2, 0, 1, 0, 0])
    assert model.predicted(unit, seats, unit.totals_now(seats, np.zeros(0)), parent).sum() == pytest.approx(1)


@pytest.mark.parametrize("most", [3, 6])
def test_seating_keeps_the_exact_posterior(most):
    """Tables of a dish: the chance of t is in proportion to fresh^t and the generalised Stirling number."""
    d, fresh, n, rng = 0.5, 0.8, 40_000, np.random.default_rng(1)
    stirling = {1: {1: 1.0}}
    for c in range(1, most):
        stirling[c + 1] = {t: stirling[c].get(t - 1, 0) + (c - d * t) * stirling[c].get(t, 0) for t in range(1, c + 2)}
    seats = Seating(np.full(n, most), d)
    for _ in range(25):
        seats.sweep(lambda t, on: np.full(len(on), fresh), rng)
    weight = np.array([fresh**t * stirling[most][t] for t in range(1, most + 1)])
    assert np.bincount(seats.tables, minlength=most + 1)[1:] / n == pytest.approx(weight / weight.sum(), abs=0.01)


def test_groups_of_customers_lay_as_many_tables_as_single_ones(monkeypatch):
    def laid():
        seats = Seating(np.full(400, 5000), 0.7)
        for _ in range(2):
            seats.sweep(lambda t, on: 1.0 + 0.3 * t, np.random.default_rng(2))
        assert seats.kept()[0].dtype == np.uint8
        again = Seating(seats.count, 0.7, seats.kept())
        assert (again.tables == seats.tables).all()
        return seats.tables

    few = laid()
    monkeypatch.setattr(pitman_yor, "SINGLY", 1 << 20)
    assert few.mean() == pytest.approx(laid().mean(), rel=0.03)


def test_split_contexts_give_the_same_totals(spark, monkeypatch):
    """Contexts that are dealt over units by word too: all their tables count in each unit."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(k, " ".join(rng.choice(["x", "y", "z", "w"], 9))) for k in range(300)], "doc_id long, text string")
    whole = pitman_yor.score_texts(rows, F.col("doc_id") % 10 != 0).toPandas().set_index("doc_id")["score"]
    monkeypatch.setattr(pitman_yor, "UNIT_BYTES", 700)
    out = pitman_yor.score_texts(rows, F.col("doc_id") % 10 != 0, split=40).toPandas().set_index("doc_id")["score"]
    assert np.abs(out.sort_index() - whole.sort_index()).max() < 0.1


def test_messages_come_back():
    x = [np.array([5, 3, 2**40], "<i8"), np.zeros(0, "<u4"), np.array([1.5, -2], "<f8")]
    for a, b in zip(x, pitman_yor._get(pitman_yor._put(*x)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
    gaps = pitman_yor._gaps(np.array([3, 1, 9], "<u4"))
    assert pitman_yor._ungapped(gaps).tolist() == [3, 1, 9]


def test_words_of_a_slice():
    texts = pa.array(["Ab c", "x  Y", "", "é É\tq"])
    hashes, place, at = pitman_yor.tokens(texts.slice(1))
    want, _, _ = pitman_yor.tokens(pa.array(["x y é É q"]))
    assert hashes[place].tolist() == want.tolist() and at.tolist() == [0, 2, 2, 5]
