"""Token tables: each distinct marked word is segmented once, and ids are joined back by position."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wavespan.llm.common import arrow_steps, id_and_text, strings

#: Distinct words that a worker's table keeps, and characters of a word that is kept: so its bytes are bounded too.
#: When it is full it starts anew, and longer words are encoded each time, which costs time, not results.
TABLE_WORDS, TABLE_CHARS = 300_000, 64
#: UTF-8 bytes whose words are looked up together.
LOOKUP_CHARS = 4_000_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTable(dict):
    """word -> value, filled by ``many`` for all the new words of a step at once."""

    def __init__(self, many: Callable[[list[str]], list], limit: int = TABLE_WORDS):
        super().__init__()
        self.many, self.limit = many, limit

    def values_of(self, words: list[str]) -> list:
        out = list(map(self.get, words))
        if None in out:
            late = [k for k, got in enumerate(out) if got is None]
            new = [words[k] for k in late]
            values = self.many(new)
            if len(self) + len(new) > self.limit:
                self.clear()
            self.update((w, v) for w, v in zip(new, values, strict=True) if len(w) <= TABLE_CHARS)
            for k, value in zip(late, values, strict=True):
                out[k] = value
        return out

    def take(self, words: pa.Array) -> tuple[np.ndarray, list]:
        """(place in the list for each word, values of the distinct words)."""
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), self.values_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())


# ---- SentencePiece ---------------------------------------------------------------------------

MARK = "▁"
MARKED = re.compile(f"{MARK}+[^{MARK}]*")
NEEDS_MARKS = f"^ |  | $|{MARK}"
_models: dict[str, object] = {}


def marked_words(text: str) -> list[str]:
    """The text's marked words, each without its first marker.

    A marker stands for a space; one is put before the text. No piece of the model goes from another
    character on to a marker, so segmentation never crosses the places where a new marked word begins.
    """
    return [w[1:] for w in MARKED.findall(MARK + text.replace(" ", MARK))] if text else []


def in_words(texts: list[str], odd: str, split: Callable[[str], list[str]]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one text after the other, and where each text's words begin.

    Texts in which the pattern ``odd`` is not found are split at single spaces; ``split`` does the others.
    """
    column = pa.array(texts, pa.large_string())
    plain = pc.split_pattern(column, " ")
    strange = pc.match_substring_regex(column, odd).to_pylist()
    if any(strange) or "" in texts:
        lists = [split(t) if s or not t else None for t, s in zip(texts, strange, strict=True)]
        values, counts, at = [], [], plain.offsets.to_numpy()
        for k, own in enumerate(lists):
            part = plain.values.slice(at[k], at[k + 1] - at[k]) if own is None else pa.array(own, pa.large_string())
            values.append(part)
            counts.append(len(part))
        return pa.concat_arrays(values), np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    return plain.values.slice(plain.offsets[0].as_py(), plain.offsets[-1].as_py() - plain.offsets[0].as_py()), plain.offsets.to_numpy() - plain.offsets[0].as_py()


class Pieces:
    """A sentencepiece model used word by word."""

    def __init__(self, path: str, limit: int = TABLE_WORDS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.get_piece_size()):
            if MARK in self.model.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece of this model crosses whitespace markers")
        self.head = self.model.encode("a")
        self.table = WordTable(self._many, limit)

    def _many(self, words: list[str]) -> list[tuple[bytes, str]]:
        """For a marked word: decimal ids joined by commas, and its text without its first marker."""
        ids = self.model.encode(words, num_threads=1)
        for k, word in enumerate(words):
            if not word.strip(MARK + " "):  # markers alone: the library puts none before an empty text
                ids[k] = self.model.encode("a" + MARK * (len(word) + 1))[len(self.head) :]
        texts = self.model.decode([self.head + own for own in ids], num_threads=1)
        return [(repr(own)[1:-1].replace(" ", "").encode(), text[2:]) for own, text in zip(ids, texts, strict=True)]

    def encode_decode(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """For each text: number of ids, decimal ids joined by commas, decoded text."""
        words, at = in_words(texts, NEEDS_MARKS, marked_words)
        places, values = self.table.take(words)
        get, out = values.__getitem__, []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if a == b:
                out.append((0, b"", ""))
                continue
            ids, parts = zip(*map(get, places[a:b].tolist()), strict=True)
            joined = b",".join(ids)
            out.append((joined.count(b",") + 1, joined, " ".join(parts)))
        return out


def piece_model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _codec(batches: Iterable[pa.RecordBatch], model: str, names: list[str], of: Callable[[int, bytes, str], tuple]):
    pieces = piece_model(model)
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for a, b in arrow_steps(texts, LOOKUP_CHARS):
            columns = zip(*[of(*got) for got in pieces.encode_decode(strings(texts, a, b))], strict=True)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *[pa.array(c) for c in columns]], names=["doc_id", *names])


def piece_codec(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ``ids`` as decimal numbers joined by commas.

    Null and empty texts have no ids and decode to the empty text. Repeated rows are answered row by row, a text of
    any length is encoded whole, and an empty table gives an empty result. ``model`` is a file that every executor can
    open.
    """
    return id_and_text(docs).mapInArrow(lambda batches: _codec(batches, model, ["n_tokens", "ids", "decoded"], lambda n, ids, text: (n, ids.decode(), text)), "doc_id long, n_tokens long, ids string, decoded string")


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """piece_codec's rows with SHA-256 digests in place of ids and decoded text, taken where they are made."""
    return id_and_text(docs).mapInArrow(
        lambda batches: _codec(batches, model, ["n_tokens", "ids_sha256", "decoded_sha256"], lambda n, ids, text: (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


# ---- byte-level BPE --------------------------------------------------------------------------

#: A pre-token never holds a space after a character that isn't white space, so ids add up over these parts.
AFTER_WORD = re.compile(r"(?<=\S)(?= )")
SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NEEDS_PARTS = f"{SPACES} | {SPACES}"


#: Longer parts, as of text without spaces, are split at all of the tokenizer's own boundaries.
LONG = 32


@cache
def _boundaries():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def _finer(part: str) -> Iterator[str]:
    """A part at those of the tokenizer's boundaries that the two characters beside them decide.

    Others depend on characters further away: those beside white space, and those of contractions like ``'s``.
    """
    held = ""
    for own in _boundaries().findall(part):
        a, b = held[-1:], own[0]
        if held and not (a.isspace() or b.isspace() or a == "'" or (a.isalpha() and b.isalpha())):
            yield held
            held = ""
        held += own
    if held:
        yield held


def pre_tokens(text: str) -> list[str]:
    """Parts of the text whose ids, one part after the other, are the text's ids; joined they are the text.

    Each is one or a few of the tokenizer's pre-tokens; one of over LONG characters is a single one but for the
    white space in it.
    """
    parts = AFTER_WORD.split(text) if text else []
    if len(text) > LONG and max(map(len, parts)) > LONG:
        return [x for part in parts for x in (_finer(part) if len(part) > LONG else (part,))]
    return parts


class Bytes:
    """A byte-level BPE used part by part; its table holds little-endian 32-bit ids.

    Where the tokenizer's file has its vocabulary as ranks beside it (same name, ``.tiktoken``), parts that
    are new to the table are merged by those ranks, which gives the same ids in a third of the time.
    """

    def __init__(self, path: str, limit: int = TABLE_WORDS):
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                vocabulary = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            one = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
            self.encode = lambda parts: map(one, parts)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            self.encode = lambda parts: (e.ids for e in model.encode_batch(parts, add_special_tokens=False))
        self.table = WordTable(self._many, limit)
        #: For words after a space, by the word without it.
        self.spaced = WordTable(lambda words: self._many([" " + w for w in words]), limit)

    def _many(self, parts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in self.encode(parts)]

    def counts(self, parts: list[str]) -> list[int]:
        """Number of ids of each part."""
        if len(parts) < 1000:
            return [len(x) // 4 for x in self.table.values_of(parts)]
        places, values = self.table.take(pa.array(parts, pa.large_string()))
        return np.array([len(x) // 4 for x in values])[places].tolist()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), NEEDS_PARTS).to_pylist()
        out = [b"".join(self.table.values_of(pre_tokens(t))) if s else b"" for t, s in zip(texts, odd, strict=True)]
        plain = [k for k, (t, s) in enumerate(zip(texts, odd, strict=True)) if t and not s]
        if plain:
            split = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")
            at = split.offsets.to_numpy()
            places, values = self.spaced.take(split.values)
            firsts = self.table.values_of(split.values.take(pa.array(at[:-1])).to_pylist())
            get = values.__getitem__
            for k, first, a, b in zip(plain, firsts, at[:-1], at[1:], strict=True):
                out[k] = b"".join([first, *map(get, places[a + 1 : b].tolist())])
        return out


def byte_model(path: str) -> Bytes:
    if path not in _models:
        _models[path] = Bytes(path)
    return _models[path]
