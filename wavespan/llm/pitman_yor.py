"""Hierarchical Pitman-Yor language model over the whole corpus: seating by Gibbs sweeps, in rounds of messages.

A word's restaurant is that of its context, the word before it. All context restaurants share one parent, the
restaurant of words without context, whose base is uniform over the V words of the training text and one unseen
word. A table of a context restaurant is a customer of the parent.

Who knows what, each a row that is written and found again by its key:

* chunks: the tokens of some documents, as places among the chunk's pairs (context, word);
* buckets of words: a word's number, its training count, its customers and tables in the parent;
* units of contexts: the pairs of their contexts over the whole corpus, with the seating of each pair. A context of
  many tokens is dealt over units by word too, as many as its training count asks for.

Chunks ask buckets for numbers and counts, and send their pairs to units. In each sweep units seat the customers of
all their pairs anew with the totals of the sweep before, and send tables by word to the buckets; these seat the
parent and answer with its totals. At last units answer each chunk with the probabilities of its pairs in the order
they were sent, so neither texts nor documents' numbers leave the chunk. Nothing is held for all words, contexts or
documents in one place, the driver gets a few sums a round, and no row has more than a bounded number of tokens.

One step of a sweep is a dish: all customers of a word in a restaurant stand up and sit down one after another, each
at a new table or an old one by the restaurant's weights, and the new seating is taken with the Metropolis-Hastings
chance that makes the step leave the dish's posterior unchanged given the other dishes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.llm.common import arrow_steps, discard, id_and_text, materialize

BEGIN, END = (xxhash.xxh64_intdigest(x, 7) for x in (b"\x20begin", b"\x20end"))
#: UTF-8 bytes of a chunk's texts, at most (or one text), and of those whose pairs a unit holds, on average.
CHUNK_BYTES, UNIT_BYTES = 8_000_000, 12_000_000
#: A context of more training tokens is dealt over several units.
SPLIT = 500_000
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
#: Up to so many customers of a dish are seated one by one; later ones in groups of 1/64 of those seated.
SINGLY = 256
PARENT_ROUNDS = 2
ADD = 0.1


# ---- messages --------------------------------------------------------------------------------


def _put(*arrays: np.ndarray) -> bytes:
    """Arrays with their first bytes first, then their second ones and so on: high bytes of small numbers are runs."""
    raw = b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), a.nbytes) + np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _get(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<2sq", raw, at)
        size = int(kind[1:])
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n, at + 10).reshape(size, n // size).T).view(kind.decode()).reshape(-1))
        at += 10 + n
    return out


def _gaps(x: np.ndarray) -> np.ndarray:
    """Differences to the entry before, around zero; cumsum of the same type gives the entries."""
    return np.diff(x, prepend=x.dtype.type(0))


def _ungapped(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


#: A row: its number, what it keeps, what it sends to rows of another kind, and sums for the driver.
ROW = "key long, own binary, mail array<struct<to: long, payload: binary>>, sums array<double>"
_MAIL = pa.list_(pa.struct([("to", pa.int64()), ("payload", pa.binary())]))
_ROW = pa.schema([("key", pa.int64()), ("own", pa.binary()), ("mail", _MAIL), ("sums", pa.list_(pa.float64()))])


def _row(key: int, own: bytes, mail: list[tuple[int, bytes]], sums) -> dict:
    return {"key": [key], "own": [own], "mail": [[{"to": to, "payload": p} for to, p in mail]], "sums": [list(map(float, sums))]}


def _letters(table: DataFrame) -> DataFrame:
    """(key, sender, payload) of all that a table's rows send."""
    return table.select(F.col("key").alias("sender"), F.explode("mail").alias("m")).select(F.col("m.to").alias("key"), "sender", F.col("m.payload").alias("payload"))


def _opened(letters: pa.Table) -> tuple[list[int], list[list[np.ndarray]]]:
    """(senders, their arrays) in the order of senders."""
    letters = letters.sort_by("sender")
    return letters["sender"].to_pylist(), [_get(p.as_py()) for p in letters["payload"]]


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(column) for column in zip(*parts, strict=True)]


def _sums(table: DataFrame, width: int) -> list[float]:
    row = table.agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)]).first()
    return [x or 0.0 for x in row]


def _cuts(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Ranges of runs that begin where ``starts`` says."""
    at = np.concatenate((np.flatnonzero(starts), [n])).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


# ---- words and their numbers -----------------------------------------------------------------


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct words, all texts' words as places there, where each text's words begin)."""
    own = texts.take(pa.array(np.arange(len(texts))))  # a copy: ascii_lower reads the wrong bytes of a slice
    split = pc.ascii_split_whitespace(pc.ascii_lower(own.cast(pa.large_string())))
    flat, at = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    full = pc.not_equal(flat, "")
    if not pc.all(full).as_py():
        kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
        flat, at = flat.filter(full), kept[at]
    coded, digest = flat.dictionary_encode(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, 7) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(coded.dictionary))
    return hashes, coded.indices.to_numpy(zero_copy_only=False), at


def _chunk(number: int, ids: pa.Array, train: np.ndarray, texts: pa.Array, buckets: int) -> dict:
    """Tokens as places among the chunk's sorted hashes; to each bucket its hashes with training counts."""
    found, place, at = tokens(texts)
    hashes = np.concatenate((found, np.array([END, BEGIN], np.uint64)))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    n = np.diff(at) + 1
    ends = np.cumsum(n) - 1
    words = np.full(len(place) + len(n), rank[-2], np.uint32)
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = rank[place]
    counts = np.bincount(words[np.repeat(train, n)], minlength=len(hashes))
    counts[rank[-1]] = train.sum()
    hashes = hashes[order]
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    mail = [(int(bucket[a]), _put(_gaps(hashes[a:b]), counts[a:b].astype("<u8"))) for a, b in _cuts(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)) != 0, len(hashes))]
    own = _put(words.astype("<u4"), n.astype("<i8"), train.astype("<u1"), ids.fill_null(0).to_numpy().astype("<i8"), ids.is_valid().to_numpy(zero_copy_only=False).astype("<u1"), rank[-1:].astype("<u4"))
    return _row(number, own, mail, [counts.sum() - counts[rank[-1]]])


def _chunks(buckets: int):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, train, texts = batch.column("doc_id"), batch.column("train").to_numpy(zero_copy_only=False), batch.column("text")
            for a, b in arrow_steps(texts, CHUNK_BYTES):
                yield pa.RecordBatch.from_pydict(_chunk(number, ids.slice(a, b - a), train[a:b], texts.slice(a, b - a), buckets), schema=_ROW)
                number += 1
            pa.default_memory_pool().release_unused()

    return run


#: A word's number is its bucket's number here and its rank by falling count in the bucket below.
RANK_BITS = 40


def _number(key: tuple[pa.Scalar, ...], letters: pa.Table) -> pa.Table:
    """A bucket: to each chunk the ranks and training counts of its words, in its order."""
    chunks, parts = _opened(letters)
    hashes, place = np.unique(np.concatenate([_ungapped(p[0]) for p in parts]), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([p[1] for p in parts]), minlength=len(hashes)).astype("<u8")
    rank = np.empty(len(hashes), "<u4")
    rank[np.argsort(-total.astype("<i8"), kind="stable")] = np.arange(len(hashes))
    places = np.split(place, np.cumsum([len(p[0]) for p in parts])[:-1])
    mail = [(chunk, _put(rank[p], total[p])) for chunk, p in zip(chunks, places, strict=True)]
    return pa.Table.from_pydict(_row(key[0].as_py(), b"", mail, [((total > 0) & (hashes != np.uint64(BEGIN))).sum()]), _ROW)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers spread over one another."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pairs(units: int, split: int, train_tokens: float, vocabulary: float):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """A chunk: its pairs to units; kept are its tokens as places among them, and sums by document."""
        words, n, train, ids, known, begin = _get(left["own"][0].as_py())
        buckets, parts = _opened(right)
        rank, total = _joined(parts)
        number = (np.repeat(np.array(buckets, np.int64), [len(p[0]) for p in parts]) << RANK_BITS) | rank
        order = np.argsort(number)
        local = np.empty(len(order), np.int64)
        local[order] = np.arange(len(order))
        words, number, total = local[words], number[order], total[order].astype(np.int64)
        before = np.concatenate((local[begin], words[:-1]))
        before[np.cumsum(n) - n] = local[begin[0]]
        pair, place = np.unique(before * len(number) + words, return_inverse=True)
        count = np.bincount(place[np.repeat(train, n) == 1], minlength=len(pair)).astype("<u8")
        context, word = pair // len(number), pair % len(number)
        parts = np.maximum(-(-total[context] // split), 1)
        unit = ((_mixed(number[context]) + np.where(parts > 1, _mixed(number[word]) % parts.astype(np.uint64), 0)) % np.uint64(units)).astype(np.uint16 if units < 1 << 16 else np.uint64)
        order = np.argsort(unit, kind="stable")
        at = np.empty(len(order), "<u4")
        at[order] = np.arange(len(order))
        unit, context, word, count = unit[order], context[order], word[order], count[order]
        mail = []
        for a, b in _cuts(np.diff(unit, prepend=unit[:1] + 1) != 0, len(unit)):
            c = context[a:b]
            starts = np.flatnonzero(np.diff(c, prepend=-1))
            mail.append((int(unit[a]), _put(_gaps(number[c[starts]]), np.diff(starts, append=b - a).astype("<u4"), total[c[starts]], number[word[a:b]], count[a:b])))
        doc = np.repeat(np.arange(len(n)), n)
        base = np.bincount(doc, np.log10((total + ADD) / (train_tokens + ADD * (vocabulary + 1)))[words], len(n))
        seen = np.bincount(doc, (total > 0)[words], len(n)).astype("<u8")
        places = np.sort((doc << 32) | at[place])  # order inside a document doesn't matter, and small gaps take less room
        return pa.Table.from_pydict(_row(key[0].as_py(), _put(_gaps((places & 0xFFFFFFFF).astype("<u4")), n, train, ids, known, base, seen), mail, [0]), _ROW)

    return run


# ---- units of contexts -----------------------------------------------------------------------


def _unit(split: int):
    def run(key: tuple[pa.Scalar, ...], letters: pa.Table) -> pa.Table:
        """A unit: its contexts, words and pairs with training counts; kept beside them, each chunk's pairs as places."""
        chunks, parts = _opened(letters)
        contexts, first, where = np.unique(np.concatenate([_ungapped(p[0]) for p in parts]), return_index=True, return_inverse=True)
        totals = np.concatenate([p[2] for p in parts])[first]
        context = np.repeat(where, np.concatenate([p[1] for p in parts]))
        words, word = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
        pair, place = np.unique(context * len(words) + word, return_inverse=True)
        count = np.bincount(place, weights=np.concatenate([p[4] for p in parts]), minlength=len(pair)).astype("<u8")
        context, word = pair // len(words), pair % len(words)
        own = _put(_gaps(contexts), totals, _gaps(words), _gaps(context.astype("<u4")), word.astype("<u4"), count, np.array([split], "<u8"))
        unit = Unit(own)
        places = np.split(place, np.cumsum([len(p[3]) for p in parts])[:-1])
        answers = [{"to": c, "payload": _put(_gaps(p.astype("<u4")))} for c, p in zip(chunks, places, strict=True)]
        out = _row(key[0].as_py(), own, unit.mail((count > 0).astype(np.int64)), [(count > 0).sum(), (count == 1).sum(), (count == 2).sum()])
        return pa.Table.from_pydict(out | {"places": [answers]}, _ROW.append(pa.field("places", _MAIL)))

    return run


class Unit:
    """Pairs of a unit's contexts and words, with counts."""

    def __init__(self, own: bytes):
        contexts, self.totals, words, context, self.word, count, split = _get(own)
        self.contexts, self.words, self.context, self.count = _ungapped(contexts), _ungapped(words), _ungapped(context), count.astype(np.int64)
        self.split = np.flatnonzero(self.totals > split[0])

    def mail(self, tables: np.ndarray) -> list[tuple[int, bytes]]:
        """To each bucket: tables by word, and by context of the contexts that other units have a part of."""
        by_word = np.bincount(self.word, tables, len(self.words)).astype("<u8")
        by_context = np.bincount(self.context, tables, len(self.contexts)).astype("<u8")[self.split]
        numbers = [self.words, self.contexts[self.split]]
        buckets = [x >> RANK_BITS for x in numbers]
        out = []
        for k in np.unique(np.concatenate(buckets)).tolist():
            cut = []
            for number, bucket, values in zip(numbers, buckets, (by_word, by_context), strict=True):
                own = slice(*np.searchsorted(bucket, [k, k + 1]))
                cut += [_gaps((number[own] & ((1 << RANK_BITS) - 1)).astype("<u4")), values[own]]
            out.append((k, _put(*cut)))
        return out

    def totals_now(self, tables: np.ndarray, split_tables: np.ndarray) -> np.ndarray:
        """Tables of each context: of split ones as the buckets say, of others as here."""
        out = np.bincount(self.context, tables, len(self.contexts))
        out[self.split] = split_tables
        return out


class Model:
    """The numbers of a sweep that hold for all restaurants."""

    def __init__(self, discount: float, parent_discount: float, vocabulary: float, customers: float, tables: float):
        self.discount, self.parent_discount, self.vocabulary = discount, parent_discount, vocabulary
        self.scale = 1 / (STRENGTH + customers)
        self.base = (STRENGTH + parent_discount * tables) / (vocabulary + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probabilities of words without context, over the vocabulary and one unseen word."""
        return (customers - self.parent_discount * tables + self.base) * self.scale

    def fresh(self, tables, context_tables, customers, parent_tables):
        """Weight of a new table where t of the dish's ``tables`` are laid: a function of t and of the dishes asked for."""
        open_, known = STRENGTH + self.discount * (context_tables - tables), customers - tables - self.parent_discount * parent_tables + self.base

        def weight(t, on):
            return (open_[on] + self.discount * t) * np.maximum(known[on] + t, self.base) * self.scale

        return weight

    def predicted(self, unit: Unit, tables, context_tables, parent) -> np.ndarray:
        """Probability of each pair's word in its context."""
        rest = STRENGTH + self.discount * context_tables
        return (unit.count - self.discount * tables + rest[unit.context] * parent[unit.word]) / (STRENGTH + unit.totals)[unit.context]


def _schedule(most: int):
    """(customers seated before, how many sit down now) for each step of a dish of ``most`` customers."""
    seated = 1
    while seated < most:
        now = 1 if seated < SINGLY else seated * 4 // SINGLY
        yield seated, now
        seated += now


class Seating:
    """Customers of many dishes, each at its own tables: kept as the tables laid at each step of the schedule."""

    def __init__(self, count: np.ndarray, discount: float, laid: tuple[np.ndarray, np.ndarray] | None = None):
        self.count, self.discount = count, discount
        self.order = np.argsort(-count, kind="stable")[: int((count > 1).sum())]
        self.sizes = count[self.order]
        rising = self.sizes[::-1]
        self.steps = [(seated, now, len(rising) - int(np.searchsorted(rising, seated, "right"))) for seated, now in _schedule(int(self.sizes[0]) if len(self.sizes) else 0)]
        self.laid = None
        if laid is not None:
            singly = sum(m for _, now, m in self.steps if now == 1)
            flat = np.concatenate((np.unpackbits(laid[0], count=singly), laid[1]))
            self.laid = np.split(flat, np.cumsum([m for *_, m in self.steps])[:-1]) if self.steps else []

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """The seating as bits of customers seated singly, and numbers of later groups."""
        one, more = ([x for x, (_, now, _) in zip(self.laid, self.steps, strict=True) if (now == 1) == single] for single in (True, False))
        return np.packbits(np.concatenate(one).astype(bool)) if one else np.zeros(0, np.uint8), np.concatenate(more).astype("<u8") if more else np.zeros(0, "<u8")

    @property
    def tables(self) -> np.ndarray:
        out = np.minimum(self.count, 1).astype(np.int64)
        if self.laid is not None:
            extra = np.zeros(len(self.order), np.int64)
            for x, (*_, m) in zip(self.laid, self.steps, strict=True):
                extra[:m] += x.astype(np.int64)
            out[self.order] += extra
        return out

    def sweep(self, fresh, rng) -> None:
        """Seat all dishes anew; ``fresh(t, dishes)`` is the weight of a new table beside t.

        The customers' weights at j seated on t tables are ``fresh`` and j - discount * t, so a seating is drawn with
        its weight over the product of the steps' sums, and taken with that product's ratio to the old seating's.
        """
        d, n = self.discount, len(self.order)
        new, old, ratio, laid = np.ones(n), np.ones(n), np.ones(n), []
        for k, (seated, now, m) in enumerate(self.steps):
            on, size = self.order[:m], 1 if now == 1 else np.minimum(now, self.sizes[:m] - seated)
            middle = seated + (size - 1) / 2
            opened = fresh(new[:m], on)
            whole = opened + middle - d * new[:m]
            drawn = rng.random(m) * whole < opened if now == 1 else rng.binomial(size, np.clip(opened / whole, 0, 1))
            if self.laid is not None:
                whole /= fresh(old[:m], on) + middle - d * old[:m]
                ratio[:m] *= whole if now == 1 else whole**size
                old[:m] += self.laid[k]
            new[:m] += drawn
            laid.append(drawn)
        if self.laid is not None:
            taken = rng.random(n) < ratio
            laid = [np.where(taken[: len(x)], x, y) for x, y in zip(laid, self.laid, strict=True)]
        self.laid = laid


def _parent(model: Model, number: int):
    def run(key: tuple[pa.Scalar, ...], letters: pa.Table) -> pa.Table:
        """A bucket: the parent's customers and tables of its words, and the tables of split contexts, to each unit."""
        units, parts = _opened(letters)
        ranks, split = ([_ungapped(p[k]) for p in parts] for k in (0, 2))
        flat = np.concatenate(ranks)
        customers = np.bincount(flat, np.concatenate([p[1] for p in parts])).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        flat = np.concatenate(split)
        tables_of = np.bincount(flat, np.concatenate([p[3] for p in parts])).astype("<u8") if len(flat) else np.zeros(0, "<u8")
        seats, rng = Seating(customers, model.parent_discount), np.random.default_rng((12, key[0].as_py(), number + 1))
        all_tables = model.base * (model.vocabulary + 1)
        for _ in range(PARENT_ROUNDS):
            others = all_tables - model.parent_discount * seats.tables
            seats.sweep(lambda t, on, others=others: (others[on] + model.parent_discount * t) / (model.vocabulary + 1), rng)
        tables = seats.tables
        mail = [(u, _put(customers[r].astype("<u8"), tables[r].astype("<u8"), tables_of[s])) for u, r, s in zip(units, ranks, split, strict=True)]
        return pa.Table.from_pydict(_row(key[0].as_py(), b"", mail, [tables.sum(), (customers == 1).sum(), (customers == 2).sum()]), _ROW)

    return run


#: The sender of what a unit left for itself in the sweep before.
SELF = -1


def _sweep(model: Model, number: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """A unit: all its dishes seated anew."""
        unit = Unit(left["own"][0].as_py())
        senders, parts = _opened(right)
        laid = parts.pop(0) if senders[0] == SELF else None
        customers, parent_tables, split_tables = (x.astype(float) for x in _joined(parts))
        seats = Seating(unit.count, model.discount, laid)
        tables = seats.tables
        context_tables = unit.totals_now(tables, split_tables)[unit.context]
        seats.sweep(model.fresh(tables, context_tables, customers[unit.word], parent_tables[unit.word]), np.random.default_rng((11, key[0].as_py(), number)))
        tables = seats.tables
        return pa.Table.from_pydict(_row(key[0].as_py(), _put(*seats.kept()), unit.mail(tables), [tables.sum()]), _ROW)

    return run


def _predict(models: list[Model]):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """A unit: to each chunk the probabilities of its pairs, averaged over the samples."""
        unit, mean = Unit(left["own"][0].as_py()), 0
        for k, model in enumerate(models):
            senders, parts = _opened(right.filter(pc.equal(right["sample"], k)))
            tables = Seating(unit.count, model.discount, parts.pop(0)).tables
            customers, parent_tables, split_tables = (x.astype(float) for x in _joined(parts))
            mean = mean + model.predicted(unit, tables, unit.totals_now(tables, split_tables), model.parent(customers, parent_tables))
        logs = np.log10(mean / len(models)).astype("<f4")
        places = left["places"][0].as_py()
        return pa.Table.from_pydict({"key": [p["to"] for p in places], "sender": [key[0].as_py()] * len(places), "payload": [_put(logs[_ungapped(_get(p["payload"])[0])]) for p in places]}, LETTERS)

    return run


LETTERS = pa.schema([("key", pa.int64()), ("sender", pa.int64()), ("payload", pa.binary())])
SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk: its documents."""
    at, n, train, ids, known, base, seen = _get(left["own"][0].as_py())
    logs, at = _joined(_opened(right)[1])[0].astype(float), _ungapped(at)
    score = np.bincount(np.repeat(np.arange(len(n)), n), logs[at], len(n))
    return pa.table({"doc_id": pa.array(ids, mask=known == 0), "train": train == 1, "n_tokens": n.astype(np.int64), "n_known": seen.astype(np.int64), "base_score": base, "score": score})


# ---- the whole -------------------------------------------------------------------------------


def _estimated(once: float, twice: float) -> float:
    """A discount from the numbers of dishes with one and two customers."""
    return min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)


def score_texts(docs: DataFrame, train, chain: tuple[int, int] = (BURN_IN, SAMPLES), split: int = SPLIT) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``train`` is a condition on doc_id; the model learns from those rows alone. A text's tokens are its words
    ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, and an end; a null or empty text has the end alone. Scores are
    log10 probabilities: ``score`` of the model, ``base_score`` of single words with 0.1 added to each count.
    Repeated rows each have their own result; a null doc_id counts as empty text in ``train`` and stays null. A text
    of any length is scored whole: a very long one is a chunk of its own. Without training rows all words are unseen;
    an empty table gives an empty result.

    Discounts are n1 / (n1 + 2 n2) of the dishes with one and two customers, strengths are 1. All units use the
    totals of the sweep before; ``chain`` gives the sweeps that are not used and those that are averaged.
    Contexts of over ``split`` training tokens are dealt over units.
    """
    rows = id_and_text(docs).withColumn("train", F.coalesce(train, F.lit(False)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(1, round(size / UNIT_BYTES))

    def by(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(units, "key").groupBy(*keys or ("key",))

    texts = materialize(rows.mapInArrow(_chunks(units), ROW), "pitman-yor-texts")
    (train_tokens,) = _sums(texts, 1)
    numbered = materialize(by(_letters(texts)).applyInArrow(_number, ROW), "pitman-yor-words")
    (vocabulary,) = _sums(numbered, 1)
    chunks = materialize(by(texts.select("key", "own")).cogroup(by(_letters(numbered))).applyInArrow(_pairs(units, split, train_tokens, vocabulary), ROW), "pitman-yor-chunks")
    discard(texts, numbered)
    table = materialize(by(_letters(chunks)).applyInArrow(_unit(split), ROW + ", places array<struct<to: long, payload: binary>>"), "pitman-yor-units")
    customers, once, twice = _sums(table, 3)
    discount, parent_discount, parent_tables = _estimated(once, twice), 0.5, vocabulary

    def seated(sender: DataFrame, number: int) -> tuple[Model, DataFrame]:
        nonlocal parent_discount, parent_tables
        model = Model(discount, parent_discount, vocabulary, customers, parent_tables)
        parent = materialize(by(_letters(sender)).applyInArrow(_parent(model, number), ROW), "pitman-yor-parent")
        parent_tables, once, twice = _sums(parent, 3)
        if number < 0:
            parent_discount = _estimated(once, twice)
        return Model(discount, parent_discount, vocabulary, customers, parent_tables), parent

    model, parent = seated(table, -1)
    left, before, samples = table.select("key", "own"), None, []
    for number in range(sum(chain)):
        letters = _letters(parent)
        if before is not None:
            letters = letters.unionByName(before.select("key", F.lit(SELF).cast("long").alias("sender"), F.col("own").alias("payload")))
        now = materialize(by(left).cogroup(by(letters)).applyInArrow(_sweep(model, number), ROW), "pitman-yor-seats")
        (customers,) = _sums(now, 1)
        if number <= chain[0]:
            discard(parent, *[before] * (before is not None))
        model, parent = seated(now, number)
        before = now
        if number >= chain[0]:
            samples.append((model, now, parent))
    letters = None
    for k, (_, now, parent) in enumerate(samples):
        own = now.select("key", F.lit(SELF).cast("long").alias("sender"), F.col("own").alias("payload"))
        some = own.unionByName(_letters(parent)).withColumn("sample", F.lit(k))
        letters = some if letters is None else letters.unionByName(some)
    answers = by(table.select("key", "own", "places")).cogroup(by(letters)).applyInArrow(_predict([m for m, *_ in samples]), "key long, sender long, payload binary")
    out = by(chunks.select("key", "own")).cogroup(by(answers)).applyInArrow(_scores, SCORES)
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(int(train_tokens)).cast("long").alias("train_tokens"), "base_score", "score")
