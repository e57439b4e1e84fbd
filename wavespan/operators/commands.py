"""Edit commands with undo and redo, folded over each recording's splits in the order of their numbers.

Each command sees what the one before it left, so this is no window function; a recording has hundreds of splits and
commands, which are the only group held at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 500
SPLIT = ["pos", "state", "title", "dropped"]


class Edit:
    """Splits by place, each (pos, state, title, dropped). Commands return the index to select next, or None."""

    def __init__(self, splits: list[tuple], total: int):
        self.splits, self.total = sorted(splits), total
        self.past: list[list[tuple]] = []
        self.future: list[list[tuple]] = []

    def insert(self, split: tuple) -> int:
        """At its place; one at the same place is replaced."""
        self.splits = sorted([s for s in self.splits if s[0] != split[0]] + [split])
        return self.splits.index(split)

    def remove(self, k: int) -> tuple | None:
        return self.splits.pop(k) if 0 <= k < len(self.splits) else None

    def move(self, k: int, pos: int) -> int | None:
        """May pass others, and replaces one that it lands on."""
        split = self.remove(k)
        return None if split is None else self.insert((pos, *split[1:]))

    def confirm(self, k: int) -> int | None:
        if not 0 <= k < len(self.splits):
            return None
        pos, _, *rest = self.splits[k]
        self.splits[k] = (pos, "Confirmed", *rest)
        return k

    def add(self, pos: int) -> int | None:
        """A confirmed split at the playhead, unless it is at an end."""
        return self.insert((pos, "Confirmed", "", False)) if 0 < pos < self.total else None

    def after(self, pos: int) -> int | None:
        return next((k for k, s in enumerate(self.splits) if s[0] > pos), None)

    def before(self, pos: int) -> int | None:
        return next((k for k in range(len(self.splits) - 1, -1, -1) if self.splits[k][0] < pos), None)

    def to_review(self, k: int | None) -> int | None:
        """The next suggested split after an index, from the first on again."""
        open_ = [j for j, s in enumerate(self.splits) if s[1] == "Suggested"]
        return next((j for j in open_ if k is None or j > k), open_[0] if open_ else None)

    def step(self, k: int | None, pos: int, forward: bool) -> int | None:
        if k is None:
            return self.after(pos) if forward else self.before(pos)
        near = k + (1 if forward else -1)
        return near if 0 <= near < len(self.splits) else None

    def confirm_and_next(self, k: int | None, pos: int) -> int | None:
        if k is None:
            found = self.to_review(self.before(pos + 1))
            return self.after(pos) if found is None else found
        self.confirm(k)
        found = self.to_review(k)
        return self.step(k, pos, True) if found is None else found

    def delete_and_next(self, k: int) -> int | None:
        return None if self.remove(k) is None else self.to_review(k - 1 if k else None)

    def _restore(self, source: list, target: list) -> int | None:
        if not source:
            return None
        old, self.splits = self.splits, source.pop()
        target.append(old)
        if old == self.splits or not self.splits:
            return None
        differs = next((k for k, (a, b) in enumerate(zip(old, self.splits, strict=False)) if a != b), min(len(old), len(self.splits)))
        return min(differs, len(self.splits) - 1)

    def record(self) -> None:
        """Remembers the state before a change, at most ``DEPTH`` of them. An equal one is not added, and redo then stays."""
        if self.past and self.past[-1] == self.splits:
            return
        self.past = [*self.past, list(self.splits)][-DEPTH:]
        self.future = []

    def apply(self, op: str, k: int | None, pos: int | None) -> int | None:
        if op in ("undo", "redo"):
            return self._restore(self.past, self.future) if op == "undo" else self._restore(self.future, self.past)
        if op in ("next", "previous"):
            return self.step(k, pos or 0, op == "next")
        self.record()
        if op == "remove":
            return None if self.remove(-1 if k is None else k) is None else k
        actions = {"move": lambda: self.move(-1 if k is None else k, pos), "confirm": lambda: self.confirm(-1 if k is None else k), "add": lambda: self.add(pos), "confirm_and_next": lambda: self.confirm_and_next(k, pos or 0), "delete_and_next": lambda: self.delete_and_next(-1 if k is None else k)}
        return actions[op]()


def _number(v) -> int | None:
    return None if pd.isna(v) else int(v)


def _fold(splits: pd.DataFrame, commands: pd.DataFrame) -> tuple[Edit, list]:
    total = int(commands["total"].iloc[0]) if len(commands) else 1 << 62
    edit = Edit([(int(p), s, t, bool(d)) for p, s, t, d in splits[SPLIT].fillna({"title": "", "dropped": False}).itertuples(index=False)], total)
    return edit, [(int(c.seq), edit.apply(c.op, _number(c.k), _number(c.pos))) for c in commands.sort_values("seq").itertuples()]


def _met(splits: DataFrame, commands: DataFrame):
    """Both tables by recording; the second's columns are made new, since both may stem from one table."""
    own = commands.select(F.col("rec").alias("of"), *[F.col(c).alias(c) for c in ("total", "seq", "op", "k", "pos")])
    return splits.select("rec", *SPLIT).groupBy("rec").cogroup(own.groupBy("of"))


def edited(splits: DataFrame, commands: DataFrame) -> DataFrame:
    """(rec, idx, pos, state, title, dropped) after the commands (rec, total, seq, op, k, pos); recordings without any stay."""

    def run(key, s, c):
        edit, _ = _fold(s, c)
        return pd.DataFrame([(key[0], k, *split) for k, split in enumerate(edit.splits)], columns=["rec", "idx", *SPLIT])

    return _met(splits, commands).applyInPandas(run, "rec string, idx long, pos long, state string, title string, dropped boolean")


def selections(splits: DataFrame, commands: DataFrame) -> DataFrame:
    """(rec, seq, selected): the index that each command selects, null for none."""

    def run(key, s, c):
        return pd.DataFrame([(key[0], n, k) for n, k in _fold(s, c)[1]], columns=["rec", "seq", "selected"]).astype({"selected": "Int64"})

    return _met(splits, commands).applyInPandas(run, "rec string, seq long, selected long")
