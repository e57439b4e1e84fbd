"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.llm.common import arrow_steps, id_and_text, materialize, strings
from wavespan.llm.tokens import LOOKUP_CHARS, byte_model

CAPACITY, SEPARATOR = 2048, 0
#: Pieces that one family of islands packs. Families are dealt at random, so each has the corpus's lengths.
FAMILY = 4096
ISLANDS, POPULATION, EPOCHS = 3, 4, 2
#: An epoch ends after so many births in a row that brought no better solution: PATIENCE at most, and two for each bin
#: over the bound that the total length sets, which is all that can be gained.
PATIENCE = 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and CRC-32 of its little-endian 32-bit ids.

    A document is its ids and then the separator; a null or empty text is the separator alone. Only documents
    longer than the capacity are cut, into full pieces but for the first.
    """

    def run(batches):
        model, end = byte_model(tokenizer), np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in arrow_steps(texts, LOOKUP_CHARS):
                rows = []
                for doc_id, raw in zip(ids[a:b], model.ids(strings(texts, a, b)), strict=True):
                    raw += end
                    n = len(raw) // 4
                    first = n % capacity or capacity
                    for piece, start in enumerate([0, *range(first, n, capacity)]):
                        stop = first if not piece else start + capacity
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(run, PIECES)


# ---- one family ------------------------------------------------------------------------------
# A solution is a list of bins; a bin is a list of item numbers.


class Packer:
    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity, self.rng = lengths.tolist(), capacity, np.random.default_rng(seed)
        self.least = -(-int(lengths.sum()) // capacity)

    def fill(self, bins: list[list[int]]) -> list[int]:
        size = self.lengths
        return [sum(size[i] for i in b) for b in bins]

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins are better, then bins more unevenly filled."""
        return -len(bins), sum((f / self.capacity) ** 2 for f in self.fill(bins))

    def best_fit(self, items: list[int], bins: list[list[int]] | None = None) -> list[list[int]]:
        """Put each item, in order, where the least room is left over."""
        bins = [list(b) for b in bins or ()]
        room = sorted((self.capacity - f, k) for k, f in enumerate(self.fill(bins)))
        for i in items:
            need = self.lengths[i]
            at = bisect.bisect_left(room, (need, -1))
            if at == len(room):
                bins.append([i])
                bisect.insort(room, (self.capacity - need, len(bins) - 1))
            else:
                left, k = room.pop(at)
                bins[k].append(i)
                bisect.insort(room, (left - need, k))
        return bins

    def falling(self, items: list[int]) -> list[int]:
        return sorted(items, key=lambda i: -self.lengths[i])

    def first(self) -> list[list[list[int]]]:
        """Best fit by falling length, the same with noise of two strengths, and in any order."""
        n, lengths = len(self.lengths), np.array(self.lengths)
        orders = [np.argsort(-lengths * self.rng.uniform(1 - noise, 1 + noise, n), kind="stable").tolist() for noise in (0.02, 0.2)]
        return [self.best_fit(order) for order in (self.falling(list(range(n))), *orders, self.rng.permutation(n).tolist())][:POPULATION]

    def replaced(self, bins: list[list[int]], loose: list[int]) -> tuple[list[list[int]], list[int]]:
        """Loose items change places with one or two items of a bin where that fills the bin better.

        A bin takes the longest loose item that fits in place of one of its own or of two, so what is left over is
        shorter and easier to fit. Full bins stay as they are.
        """
        size, capacity = self.lengths, self.capacity
        pool = sorted((size[i], i) for i in loose)
        out = []
        for own in bins:
            room = capacity - sum([size[i] for i in own])
            if room and pool:
                own = list(own)
                gone = [(size[i], (i,)) for i in own] + [(size[i] + size[j], (i, j)) for k, i in enumerate(own[:8]) for j in own[k + 1 : 8]]
                best = None
                for freed, items in gone:
                    at = bisect.bisect_right(pool, (freed + room, len(size)))
                    if at and pool[at - 1][0] > freed and (best is None or pool[at - 1][0] - freed > best[0]):
                        best = pool[at - 1][0] - freed, items, pool[at - 1]
                if best:
                    pool.remove(best[2])
                    own = [i for i in own if i not in best[1]] + [best[2][1]]
                    for i in best[1]:
                        bisect.insort(pool, (size[i], i))
            out.append(own)
        return out, [i for _, i in pool]

    def settled(self, bins: list[list[int]], loose: list[int]) -> list[list[int]]:
        """Displaced items: exchanged for shorter ones first, then put where they fit best."""
        bins, loose = self.replaced(bins, loose)
        return self.best_fit(self.falling(loose), bins)

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        """b's well-filled bins go into a whole; a's bins with any of their documents are broken up."""
        fills = self.fill(b)
        order = sorted(range(len(b)), key=lambda k: -fills[k] + self.rng.integers(0, max(1, self.capacity // 64)))
        injected = [b[k] for k in order[: max(1, int(len(b) * self.rng.uniform(0.2, 0.6)))]]
        taken = {i for x in injected for i in x}
        whole = [x for x in a if taken.isdisjoint(x)]
        loose = [i for x in a if not taken.isdisjoint(x) for i in x if i not in taken]
        return self.settled(injected + whole, loose)

    def mutate(self, bins: list[list[int]]) -> list[list[int]]:
        """Break up the emptiest bins and a few others."""
        fills = self.fill(bins)
        order = np.argsort(fills, kind="stable").tolist()
        broken = set(order[: max(1, len(bins) // 50)]) | set(self.rng.integers(0, len(bins), max(1, len(bins) // 20)).tolist())
        loose = [i for k in broken for i in bins[k]]
        return self.settled([b for k, b in enumerate(bins) if k not in broken], loose)

    def evolve(self, population: list[list[list[int]]], patience: int = PATIENCE) -> list[list[list[int]]]:
        """Best first. It ends when too many births brought nothing better, or when a solution has as few bins as the
        total length allows. Equal solutions count once, so that the population stays mixed."""
        ranked = sorted(((self.fitness(x), x) for x in population), key=lambda s: s[0], reverse=True)[:POPULATION]
        idle = 0
        while self.lengths and idle < min(patience, 2 * (len(ranked[0][1]) - self.least)):
            a, b = self.rng.integers(0, len(ranked), 2)
            child = self.cross(ranked[min(a, b)][1], ranked[max(a, b) if a != b else (a + 1) % len(ranked)][1])
            child = self.mutate(child) if self.rng.random() < 0.7 else child
            value = self.fitness(child)
            idle = 0 if value > ranked[0][0] else idle + 1
            if value not in [v for v, _ in ranked]:
                ranked = sorted([*ranked, (value, child)], key=lambda s: s[0], reverse=True)[:POPULATION]
        return [x for _, x in ranked]


def _bytes_of(bins: list[list[int]], n: int) -> bytes:
    place = np.empty(n, "<i4")
    for k, b in enumerate(bins):
        place[b] = k
    return place.tobytes()


def _bins_of(raw: bytes) -> list[list[int]]:
    out = defaultdict(list)
    for i, k in enumerate(np.frombuffer(raw, "<i4").tolist()):
        out[k].append(i)
    return list(out.values())


ISLAND = "family long, island int, lengths binary, population array<binary>, elite boolean"


def _arrows(df: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(df, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def pack(pieces: DataFrame, capacity: int = CAPACITY, family: int = FAMILY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset; offsets are gapless from 0.

    Full pieces are sequences of their own. The others are dealt to families of about ``family`` pieces; each
    family has islands that evolve apart and hand their best solution to the next island after every epoch. Of bins
    with equally little room the one opened first is taken. An empty table gives an empty result; repeated rows are
    pieces like others, and so are the pieces of very long texts.
    """
    spark = pieces.sparkSession
    rows = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    full = rows.filter(F.col("length") >= capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = rows.filter(F.col("length") < capacity)
    families = max(1, -(-loose.count() // family))
    loose = loose.withColumn("family", F.pmod(F.xxhash64("row"), F.lit(families)))

    def gather(key, pdf):
        pdf = pdf.sort_values("row", kind="stable")
        own = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].astype({"doc_id": "Int64"})
        return pd.DataFrame({"family": [key[0]], "lengths": [pdf["length"].to_numpy("<i4").tobytes()], "pieces": [_arrows(own)]})

    held = materialize(loose.groupBy("family").applyInPandas(gather, "family long, lengths binary, pieces binary"), "pack-families")

    def epoch(key, pdf):
        """One island: its own population and the neighbour's elite, or a first population."""
        lengths = np.frombuffer(pdf["lengths"].iloc[0], "<i4")
        own = Packer(lengths, capacity, zlib.crc32(repr(tuple(map(int, key))).encode()) + len(pdf))
        population = [_bins_of(x) for row in pdf["population"] if row is not None for x in row]
        ranked = [_bytes_of(b, len(lengths)) for b in own.evolve(population or own.first())]
        raw = pdf["lengths"].iloc[0]
        return pd.DataFrame({"family": [key[0]] * 2, "island": [key[1], (key[1] + 1) % ISLANDS], "lengths": [raw] * 2, "population": [ranked, ranked[:1]], "elite": [False, True]})

    state = held.select("family", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"), "lengths", F.lit(None).cast("array<binary>").alias("population"), F.lit(False).alias("elite"))
    for _ in range(EPOCHS):  # the rows are few and small, so their number of partitions is said: a few islands are a task's work
        state = state.repartition(families, "family", "island").groupBy("family", "island").applyInPandas(epoch, ISLAND)

    def best(key, left, right):
        """The family's best solution, laid out; the pieces come from the right."""
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
        table = pa.ipc.open_stream(right["pieces"].iloc[0]).read_pandas()
        own = Packer(table["length"].to_numpy(), capacity, 0)
        bins = max((_bins_of(x) for row in left["population"] for x in row), key=own.fitness)
        sequence, offset = np.empty(len(table), np.int64), np.empty(len(table), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = (int(key[0]) << 32) + k, at
                at += own.lengths[i]
        return table.assign(sequence_id=sequence, offset=offset)

    packed = state.filter(~F.col("elite")).groupBy("family").cogroup(held.groupBy("family")).applyInPandas(best, PIECES + ", sequence_id long, offset long")
    return full.unionByName(packed)
