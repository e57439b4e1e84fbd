"""Edit-aware token counts: a tree of pre-tokens per document, of which an edit re-encodes only what it touches."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavespan.llm.common import arrow_steps, ship, strings
from wavespan.llm.tokens import LOOKUP_CHARS, Bytes, byte_model, pre_tokens

#: Pre-tokens of a leaf.
LEAF = 32
EDITS = "array<struct<start: long, stop: long, replacement: string>>"


@dataclass(frozen=True, slots=True)
class Node:
    """A run of pre-tokens with the sums of its subtree; a leaf has ``parts`` and ``counts``, others two children."""

    chars: int
    tokens: int
    n: int
    depth: int
    parts: tuple = ()
    counts: tuple = ()
    left: Node | None = None
    right: Node | None = None


EMPTY = Node(0, 0, 0, 0)


def leaf(parts, counts) -> Node:
    return Node(sum(map(len, parts)), sum(counts), len(parts), 0, tuple(parts), tuple(counts))


def over(a: Node, b: Node) -> Node:
    return Node(a.chars + b.chars, a.tokens + b.tokens, a.n + b.n, 1 + max(a.depth, b.depth), left=a, right=b)


def join(a: Node, b: Node) -> Node:
    """One tree of both, with one rotation at most at each level of the deeper one's edge."""
    if not a.n or not b.n:
        return a if a.n else b
    if a.n + b.n <= LEAF and not a.depth and not b.depth:
        return leaf(a.parts + b.parts, a.counts + b.counts)
    if a.depth > b.depth + 1:
        side = join(a.right, b)
        if side.depth <= a.left.depth + 1:
            return over(a.left, side)
        if side.left.depth <= side.right.depth:
            return over(over(a.left, side.left), side.right)
        return over(over(a.left, side.left.left), over(side.left.right, side.right))
    if b.depth > a.depth + 1:
        side = join(a, b.left)
        if side.depth <= b.right.depth + 1:
            return over(side, b.right)
        if side.right.depth <= side.left.depth:
            return over(side.left, over(side.right, b.right))
        return over(over(side.left, side.right.left), over(side.right.right, b.right))
    return over(a, b)


def build(parts, counts) -> Node:
    nodes = [leaf(parts[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(parts), LEAF)] or [EMPTY]
    while len(nodes) > 1:
        nodes = [over(a, b) for a, b in zip(nodes[::2], nodes[1::2], strict=False)] + nodes[len(nodes) & ~1 :]
    return nodes[0]


def split(node: Node, k: int) -> tuple[Node, Node]:
    """The first k pre-tokens, and the others."""
    if k <= 0:
        return EMPTY, node
    if k >= node.n:
        return node, EMPTY
    if not node.depth:
        return leaf(node.parts[:k], node.counts[:k]), leaf(node.parts[k:], node.counts[k:])
    if k <= node.left.n:
        a, b = split(node.left, k)
        return a, join(b, node.right)
    a, b = split(node.right, k - node.left.n)
    return join(node.left, a), b


def find(node: Node, at: int) -> tuple[int, int]:
    """(number of the pre-token that holds the character, where it begins); past the end, the last one."""
    number = start = 0
    while node.depth:
        if at < start + node.left.chars:
            node = node.left
        else:
            number, start, node = number + node.left.n, start + node.left.chars, node.right
    for k, part in enumerate(node.parts):
        if at < start + len(part) or k == len(node.parts) - 1:
            return number + k, start
        start += len(part)
    return number, start


def in_order(node: Node):
    if node.depth:
        yield from in_order(node.left)
        yield from in_order(node.right)
    else:
        yield from node.parts


class TokenTree:
    """A document's token count under edits; ``encoded`` counts the pre-tokens that were encoded."""

    def __init__(self, model: Bytes, parts: list[str], counts: list[int]):
        self.model, self.root, self.encoded = model, build(parts, counts), len(parts)

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def text(self) -> str:
        return "".join(in_order(self.root))

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Put ``replacement`` in place of the characters [start, stop), both cut to the text.

        A boundary of pre-tokens depends on the two characters beside it, so one pre-token on either side of the
        touched ones is context enough.
        """
        start = min(max(start, 0), self.root.chars)
        stop = min(max(stop, start), self.root.chars)
        if not self.root.n:
            lo = hi = at = 0
        else:
            lo = max(0, find(self.root, start)[0] - 1)
            hi = min(self.root.n, find(self.root, max(stop - 1, start))[0] + 2)
        before, rest = split(self.root, lo)
        touched, after = split(rest, hi - lo)
        at = before.chars
        old = "".join(in_order(touched))
        parts = pre_tokens(old[: start - at] + replacement + old[stop - at :])
        self.encoded += len(parts)
        self.root = join(join(before, build(parts, self.model.counts(parts))), after)


def edited_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs (doc_id, text, edits) to (doc_id, n_tokens, n_tokens_edited, n_parts, n_parts_edited, n_parts_encoded).

    ``edits`` is an array of (start, stop, replacement), in characters, applied in order, each to the text that the
    one before left. Null texts and edits count as empty; positions outside the text are cut to it; a null
    replacement is empty. n_parts_encoded counts what the edits had encoded, context included. Repeated rows are
    answered row by row; a text of any length is one tree; an empty table gives an empty result.
    """

    def run(batches):
        model = byte_model(tokenizer)
        for batch in batches:
            ids, texts, edits = batch.column("doc_id"), batch.column("text"), batch.column("edits")
            for a, b in arrow_steps(texts, LOOKUP_CHARS):
                lists = [pre_tokens(t) for t in strings(texts, a, b)]
                counts, at, rows = model.counts([p for own in lists for p in own]), 0, []
                for parts, todo in zip(lists, edits.slice(a, b - a).to_pylist(), strict=True):
                    tree = TokenTree(model, parts, counts[at : at + len(parts)])
                    at += len(parts)
                    tokens = tree.tokens
                    for e in todo or ():
                        if e is not None:
                            tree.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                    rows.append((tokens, tree.tokens, len(parts), tree.root.n, tree.encoded - len(parts)))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_tokens", "n_tokens_edited", "n_parts", "n_parts_edited", "n_parts_encoded"])

    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("edits").cast(EDITS).alias("edits"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_edited long, n_parts long, n_parts_edited long, n_parts_encoded long")
