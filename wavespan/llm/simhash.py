"""SimHash near-duplicates by covering locality-sensitive hashing, and linked groups without all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.llm.common import arrow_steps, discard, id_and_text, materialize, strings, words

BITS, SEED = 64, 42
#: A run of fingerprints that agree on a mask is compared pair by pair up to this size; a larger one is split by
#: further masks of the bits that the mask leaves.
PAIRWISE = 1024
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str, width: int = 4) -> int:
    """A bit is 1 if it is set in over half the XXH64 values of the word shingles, repeats included."""
    own = words(text)
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= width:
        shingles = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = list(zip(starts[: len(own) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True))
    digest, ones = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for k in range(0, len(shingles), SHINGLES_AT_ONCE):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in shingles[k : k + SHINGLES_AT_ONCE]])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 4, carry=None) -> DataFrame:
    """(doc_id, fp long) for every row; a text without words, also a null one, has fingerprint zero.

    ``carry`` is a column of docs that comes along as ``key``.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in arrow_steps(texts):
                prints = pa.array([fingerprint(t, width) for t in strings(texts, a, b)], pa.int64())
                more = [batch.column(k).slice(a, b - a) for k in batch.schema.names if k != "text"]
                yield pa.RecordBatch.from_arrays([prints, *more], names=["fp", *[k for k in batch.schema.names if k != "text"]])

    rows = id_and_text(docs, *([] if carry is None else [carry.alias("key")]))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(run, ", ".join(["fp long", *kinds])).select("doc_id", "fp", *([] if carry is None else ["key"]))


def covering_masks(radius: int, bits: tuple[int, ...] = tuple(range(BITS))) -> list[int]:
    """2^(radius+1) - 1 masks of some bits; values within the radius on these agree on all bits of at least one mask.

    Each bit position has a vector of radius+1 bits, and a mask holds the positions whose vector has an odd
    product with the mask's own nonzero vector. The vectors of at most ``radius`` differing positions leave
    room for one nonzero vector with even products to all of them: its mask has none of these positions.
    """
    size = 1 << (radius + 1)
    order = sorted(range(1, size), key=lambda v: (v.bit_count() > 1, v))  # unit vectors first: no mask is empty over radius+1 positions
    vectors = {bits[k]: order[n % (size - 1)] for n, k in enumerate(np.random.default_rng(SEED).permutation(len(bits)).tolist())}
    masks = [sum(1 << bit for bit, m in vectors.items() if (m & v).bit_count() & 1) for v in range(1, size)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _linked(run: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(value, least value linked with it) of one run of distinct values, by all pairs."""
    bits = run.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(run))
    while True:
        least = np.where(near, label[None, :], len(run)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(a, b) for a, b in zip(run.tolist(), run[label].tolist(), strict=True) if a != b]


def _runs(batches, radius: int, pairwise: int):
    """Links within runs of equal (mask, part) in sorted rows; the rows (value, mask) of longer runs come back as ``large``.

    Where a mask leaves at most ``radius`` bits, its run's values all are linked, each with the one before.
    """
    held, held_key, large = [], None, False
    # held: values of the last run so far; large: it has already been handed on

    def out(a, b, kind):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([kind] * len(a), pa.bool_())], names=["a", "b", "large"])

    def whole(run, mask):
        run = np.unique(run)
        if BITS - (int(mask) & (1 << 64) - 1).bit_count() <= radius:
            return list(zip(run[1:].tolist(), run[:-1].tolist(), strict=True))
        return _linked(run, radius) if len(run) > 1 else []

    for batch in batches:
        mask, part, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("mask", "part", "fp"))
        if not len(fp):
            continue
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
        bounds = np.concatenate(([0], cut, [len(fp)]))
        links, rest, rest_of = [], [], []
        sizes = np.diff(bounds)
        for k in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
            a, b = bounds[k], bounds[k + 1]
            key, values = (mask[a], part[a]), np.unique(fp[a:b])
            if key != held_key:
                if len(held) > 1:
                    links += whole(np.array(held), held_key[0])
                held, held_key, large = [], key, False
            if large or len(held) + len(values) > pairwise:
                rest += [*held, *values.tolist()]
                rest_of += [int(mask[a])] * (len(held) + len(values))
                held, large = [], True
            elif b == len(fp):
                held += values.tolist()
            else:
                links += whole(np.concatenate((held, values)).astype(np.int64) if held else values, mask[a])
                held = []
        if links:
            yield out(*zip(*links, strict=True), False)
        if rest:
            yield out(rest, rest_of, True)
    if len(held) > 1 and (links := whole(np.array(held), held_key[0])):
        yield out(*zip(*links, strict=True), False)


def _split(batches, radius: int):
    """Each value of a long run under further masks, which hold the run's mask and part of the bits that it leaves."""
    known: dict[int, np.ndarray] = {}
    for batch in batches:
        masks, values = batch.column("mask").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False)
        for mask in np.unique(masks).tolist():
            if mask not in known:
                free = tuple(k for k in range(BITS) if not mask >> k & 1)
                known[mask] = np.unique(np.array([m | mask for m in covering_masks(radius, free)], np.int64))
            own = values[masks == mask]
            for k in range(0, len(own), 1 << 14):
                some, finer = own[k : k + (1 << 14)], known[mask]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(finer, len(some))), pa.array((some[:, None] & finer[None, :]).ravel()), pa.array(np.repeat(some, len(finer)))], names=["mask", "part", "fp"])


def links(values: DataFrame, radius: int = 4, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b): links between distinct 64-bit values (column fp) that join all those within the radius.

    Values meet in the tables of covering_masks, so none is missed. Within a run the links are a forest, not
    all pairs. A run of over ``pairwise`` values is split by a covering family of the bits that its mask leaves, and
    so on: each time about half of them, so runs end, and values within the radius still meet in one of the parts.
    """
    spread = values.select("fp", F.explode(F.array(*[F.lit(m) for m in covering_masks(radius)])).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
    found = []
    while True:
        met = materialize(spread.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp").mapInArrow(lambda x: _runs(x, radius, pairwise), "a long, b long, large boolean"), "simhash-runs")
        found.append(met.filter(~F.col("large")).select("a", "b"))
        long = met.filter("large").select(F.col("a").alias("fp"), F.col("b").alias("mask"))
        if long.isEmpty():
            break
        spread = long.distinct().mapInArrow(lambda x: _split(x, radius), "mask long, part long, fp long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over edges (a, b), by alternating large and small stars.

    Each round moves links towards smaller nodes and is written to the shared folder. A node's neighbours are folded
    to their least before the shuffle; the joins' other side has one row for each node, so none is gathered, and a
    node with many links is rows of a sorted run, which adaptive execution splits where they are too many for a task.
    An empty table of edges gives an empty result.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "simhash-edges")
    digest = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        stars = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = stars.groupBy("a").agg(F.min("b").alias("m"))
        small = stars.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, materialize(small, "simhash-edges")
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        discard(before)
        if seen == digest:
            break
        digest = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


#: A value of over 1/HOT of all rows meets its component where its rows are, the others by a shuffle.
HOT = 1000
#: Parts that the values of one component are dealt to where they meet what they have in common.
SALTS = 32


def told(rows: DataFrame, common: DataFrame) -> DataFrame:
    """rows (fp, root, ...) with the columns of ``common`` (root, ...), one row for each root.

    A root's rows are dealt to SALTS parts, to each of which goes a copy of the root's row, so that a component of
    very many values isn't one task's work.
    """
    copies = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(copies, ["root", "salt"]).drop("salt")


def linked(values: DataFrame, radius: int = 4, pairwise: int = PAIRWISE) -> DataFrame:
    """(fp, root) of the distinct values (column fp) that are linked with others: the least value of their component."""
    found = components(links(values, radius, pairwise))
    own = found.select(F.col("root").alias("fp"), "root").distinct()
    return materialize(found.select(F.col("node").alias("fp"), "root").unionByName(own), "simhash-roots")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, pairwise: int = PAIRWISE) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over fingerprints within the radius.

    Texts without words share fingerprint zero and are linked like others; a text of any length is fingerprinted
    whole. A null doc_id takes part in links but is never the smallest; a component of null doc_ids alone has a null
    component_id. Equal fingerprints are one value from here on, so copies and repeated rows cost no pairs. An empty
    table gives an empty result.
    """
    prints = materialize(fingerprints(docs, width), "simhash-prints")
    values = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "simhash-values")
    met = linked(values.select("fp"), radius, pairwise).join(values, "fp")
    least = told(met, met.groupBy("root").agg(F.min("first").alias("least"))).select("fp", "least", F.lit(True).alias("met"))
    found = values.join(least, "fp", "left").select("fp", "copies", F.when(F.col("met"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    found = materialize(found, "simhash-components")
    rows = values.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") * HOT > F.lit(rows)
    hot = F.broadcast(found.filter(often).drop("copies"))  # at most HOT rows
    cold = prints.join(hot, "fp", "left_anti").join(found.filter(~often).drop("copies"), "fp")
    return prints.join(hot, "fp").unionByName(cold).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row of each component, with docs' columns: that of the smallest doc_id.

    Of rows of that doc_id the one with the least hash of its text stays, and of equal rows one; rows that share a
    doc_id but not a component are different documents and both stay. A row with a null doc_id stays where its
    component has no other. A null text counts as empty. An empty table stays empty. Columns may have any names.
    """
    free = (f"{name}{k or ''}" for k in range(len(docs.columns) + 1) for name in ("own",))
    own = next(n for n in free if n.lower() not in {c.lower() for c in docs.columns})
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("hash"), F.xxhash64(F.reverse(text), F.length(text)).alias("other"))
    prints = materialize(fingerprints(docs, carry=key), "simhash-prints")
    values = materialize(prints.groupBy("fp").agg(F.min("key").alias("key")), "simhash-values")
    found = values.join(linked(values.select("fp"), radius), "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("key").alias(own))
    equal = prints.groupBy(F.col("key").alias(own)).count().filter("count > 1").drop("count")
    kept, keyed = materialize(found.select(own), "simhash-kept"), docs.withColumn(own, key)
    # texts cross the network once and aren't sorted: a part's keys are held, and its rows go by
    single = keyed.join(kept.join(equal, own, "left_anti").hint("shuffle_hash"), own, "left_semi")
    repeated = materialize(kept.join(equal, own, "left_semi"), "simhash-repeated")
    out = single if repeated.isEmpty() else single.unionByName(keyed.join(repeated.hint("shuffle_hash"), own, "left_semi").dropDuplicates([own]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
