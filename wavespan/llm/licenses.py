"""License scans: windows compressed with each template as a raw dictionary, winners confirmed word by word."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from wavespan.llm.common import id_and_text, id_text_steps

#: Wording of public licenses and of common notices.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "Apache-2.0": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software."
    ),
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MPL-2.0 notice": "Licensed under the Mozilla Public License, version 2.0.",
    "BSD notice": "Distributed under the BSD License.",
    "CC0-1.0 notice": "Dedicated to the public domain under CC0 1.0.",
}
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"] + (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
#: By rule: GNU licenses are worded alike but for what they are for, their name and version.
for _name, _for, _words, _versions in (("GPL", "program", "", (2, 3)), ("LGPL", "library", "Lesser ", (2.1, 3)), ("AGPL", "program", "Affero ", (3,))):
    for _v in _versions:
        _spdx = f"{_name}-{float(_v)}"
        TEMPLATES[_spdx] = (
            f"This {_for} is free software: you can redistribute it and/or modify it under the terms of the GNU {_words}General Public License as "
            f"published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version."
        )
        TEMPLATES[f"{_spdx} notice"] = f"This work is licensed under the GNU {_words}General Public License, version {_v}."
#: By rule: the kinds and versions of Creative Commons licenses, by short and long names.
_LONG = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        TEMPLATES[f"CC-{_kind}-{_v} notice"] = f"Licensed under CC {_kind} {_v}."
        TEMPLATES[f"CC-{_kind}-{_v}"] = f"Creative Commons {'-'.join(_LONG[x] for x in _kind.split('-'))} {_v}"
ANCHOR = re.compile(r"licen[sc]e|permission|redistribut|copyright|warrant|public domain|free software|creative commons|mozilla|is free to copy|software must not", re.I)
#: A sentence ends at a mark before white space or at lines without words; other line ends are those of wrapped text.
BREAK = re.compile(r"[.!?](?=\s|\Z)|\n(?:[^\w\n]*\n)+")
WORD, WORDLIKE = re.compile(r"[a-z0-9]+"), re.compile(r"\w")
#: Least share of a template's words that a span must have in order; it may have as many other words as may lack, and one.
COVER = 0.8
#: A template of fewer words is a notice, of which each word counts: it is there to the word, or not at all.
SHORT = 20
#: Results are kept for blocks of up to so many characters.
KEPT_CHARS = 4000
#: Levels of compression that rank what is found, and that find it: at the first, notices among others were missed, at the second none of 6,286 made ones.
LEVEL, FIND = 3, 19


@dataclass(frozen=True)
class Block:
    start: int
    stop: int
    text: str


def candidate_blocks(text: str) -> list[Block]:
    """Runs of neighbouring sentences, over any line ends, of which each has an anchor word, or stands between two that have one."""
    if not ANCHOR.search(text):
        return []
    ends = [*(m.end() for m in BREAK.finditer(text)), len(text)]
    spans = [(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True) if WORDLIKE.search(text, a, b)]
    hit = [bool(ANCHOR.search(text, a, b)) for a, b in spans]
    out, k = [], 0
    while k < len(spans):
        if not hit[k]:
            k += 1
            continue
        last = k
        while last + 1 < len(spans) and (hit[last + 1] or (last + 2 < len(spans) and hit[last + 2])):
            last += 1
        out.append(Block(spans[k][0], spans[last][1], text[spans[k][0] : spans[last][1]]))
        k = last + 1
    return out


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


_PLAIN = {"write_checksum": False, "write_content_size": False}


@lru_cache(maxsize=1)
def _compressors() -> dict[str, tuple[list[str], zstandard.ZstdCompressor, zstandard.ZstdCompressor]]:
    """Of each template its words, and its compressors that rank and that find."""
    out = {}
    for name, text in TEMPLATES.items():
        own = words_of(text)
        raw = zstandard.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out[name] = own, *(zstandard.ZstdCompressor(level=level, dict_data=raw, write_dict_id=False, **_PLAIN) for level in (LEVEL, FIND))
    return out


def _width(template: list[str]) -> int:
    """The most words over which a template may be spread."""
    return len(template) + int((1 - COVER) * len(template) + 1)


def winners(words: list[str]) -> dict[str, list[tuple[int, int]]]:
    """Of each template the runs of words whose windows are smaller when compressed with it as a dictionary.

    A window is twice as wide as the template may be spread, and the next one begins in its middle, so any such span
    is whole in one of them, whatever the block's length. Runs go on for a width at both ends.
    """
    plain, sizes, out = zstandard.ZstdCompressor(level=FIND, **_PLAIN), {}, {}
    for name, (template, _, compressor) in _compressors().items():
        width = _width(template)
        if width not in sizes:
            parts = [(k, " ".join(words[k : k + 2 * width]).encode()) for k in range(0, max(len(words) - width, 1), width)]
            sizes[width] = [(k, raw, len(plain.compress(raw))) for k, raw in parts]
        runs: list[tuple[int, int]] = []
        for k, raw, size in sizes[width]:
            if len(compressor.compress(raw)) < size:
                a, b = max(k - width, 0), min(k + 3 * width, len(words))
                runs[-1:] = [(runs[-1][0], b)] if runs and a <= runs[-1][1] else [*runs[-1:], (a, b)]
        if runs:
            out[name] = runs
    return out


def differences(template: list[str], block: list[str]) -> tuple[list[int], int, str]:
    """(places in the block of template words found in order, words of the block between them that the template
    lacks, the differences).

    Words of the block before its first and after its last match aren't the license's.
    """
    match = [b for b in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if b.size]
    if not match:
        return [], 0, ""
    found, extra, said = [k for b in match for k in range(b.b, b.b + b.size)], 0, []
    ends = [difflib.Match(0, match[0].b, 0), *match, difflib.Match(len(template), match[-1].b + match[-1].size, 0)]
    for p, q in zip(ends[:-1], ends[1:], strict=True):
        gone, new = template[p.a + p.size : q.a], block[p.b + p.size : q.b]
        extra += len(new)
        said += [f"-{w}" for w in gone] + [f"+{w}" for w in new]
    return found, extra, " ".join(said)


@dataclass(frozen=True)
class Match:
    license: str
    places: frozenset[int]
    added: int
    said: str


def exact_matches(name: str, template: list[str], words: list[str]) -> list[Match]:
    n, first = len(template), template[0]
    return [Match(name, frozenset(range(k, k + n)), 0, "") for k, w in enumerate(words) if w == first and words[k : k + n] == template]


def near_matches(name: str, template: list[str], words: list[str]) -> list[Match]:
    """Matches within the limits. Each is in a window of ``width`` words with enough of the template's, in any order."""
    need, least, spare = Counter(template), COVER * len(template), (1 - COVER) * len(template) + 1
    width = _width(template)
    have, common, shared = Counter(), 0, []
    for k, w in enumerate([*words, *[""] * (width - 1)][: max(len(words), width)]):
        have[w] += 1
        common += have[w] <= need[w]
        if k >= width:
            old = words[k - width]
            common -= have[old] <= need[old]
            have[old] -= 1
        if k >= width - 1:
            shared.append(common)
    out, k = [], 0
    while k < len(shared):
        if shared[k] < least:
            k += 1
            continue
        near = shared[k : k + width]
        k += near.index(max(near))
        found, added, said = differences(template, words[k : k + width])
        versions = [w for w in template if any(map(str.isdigit, w))]
        if len(found) >= least and added <= spare and not Counter(versions) - Counter(words[k + x] for x in found):
            out.append(Match(name, frozenset(k + x for x in found), added, said))
            k += found[-1]
        k += 1
    return out


def _moved(matches: list[Match], by: int) -> list[Match]:
    return [Match(m.license, frozenset(k + by for k in m.places), m.added, m.said) for m in matches]


def _scan(text: str) -> tuple[tuple, ...]:
    words = words_of(text)
    exact, near = [], []
    for name, runs in winners(words).items():
        template = _compressors()[name][0]
        same = [m for a, b in runs for m in _moved(exact_matches(name, template, words[a:b]), a)]
        exact += same
        near += [] if same or len(template) < SHORT else [m for a, b in runs for m in _moved(near_matches(name, template, words[a:b]), a)]
    exact = [m for m in exact if not any(m.places < o.places for o in exact)]
    taken = frozenset().union(*(m.places for m in exact))
    near = [m for m in near if not m.places & taken]
    near = [m for m in near if not any(m.places < o.places for o in near)]
    best: dict[str, Match] = {}
    for m in exact + near:
        if m.license not in best or len(m.places) - m.added > len(best[m.license].places) - best[m.license].added:
            best[m.license] = m
    out = []
    for name, m in best.items():
        template, compressor, _ = _compressors()[name]
        raw = " ".join(words[min(m.places) : max(m.places) + 1]).encode()
        plain = len(zstandard.ZstdCompressor(level=LEVEL, **_PLAIN).compress(raw))
        out.append((name, round((plain - len(compressor.compress(raw))) / plain, 6), len(template), len(template) - len(m.places), m.added, m.said))
    return tuple(sorted(out, key=lambda r: (r[1], r[0]), reverse=True))


_scan_kept = lru_cache(maxsize=20_000)(_scan)


def scan_block(text: str) -> tuple[tuple, ...]:
    """(license, saved share, template words, missing, added, differences) of each license found, best saving first.

    A license's best span counts, of equally good ones the first. Spans that agree to the word take their words:
    others that share some of these are left out, as are those whose words are all among the more words of another
    one. A template's version numbers have to be there, so that one version is never taken for another.
    """
    return _scan_kept(text) if len(text) <= KEPT_CHARS else _scan(text)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per license found in a block: doc_id, block_start, block_stop (characters), license, saved,
    template_words, missing_words, added_words, wording.

    ``saved`` is of the license's own span. Where a template agrees to the word, others don't count on its words;
    elsewhere all within the limits do, as ``wording`` says by what they differ. Null and empty texts and texts without
    anchor words give no rows, and so does an empty table; repeated rows give their rows each; a text of any length is
    scanned whole. Licenses that save equally are in falling order of their names.
    """

    def run(batches):
        for ids, texts in id_text_steps(batches):
            rows = [(i, b.start, b.stop, *found) for i, t in zip(ids.to_pylist(), texts, strict=True) for b in candidate_blocks(t) for found in scan_block(b.text)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "block_start", "block_stop", "license", "saved", "template_words", "missing_words", "added_words", "wording"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, block_start long, block_stop long, license string, saved double, template_words long, missing_words long, added_words long, wording string")
