"""License scans by conditional compression.

Words of license language ("cues"; their parts may stand on different lines) mark a text. Around
them, as far as the longest template reaches, every template is aligned with the words of the
text, whatever the line breaks: a word of the template may be missing, and words of the text may
come in between. An alignment counts if few words of the template are missing and if the aligned
passage, compressed by zstandard with the template as a raw dictionary, is so much shorter than
on its own. Passages that count are taken the longest template first, their words are set apart,
and the search goes on in the rest until nothing more is found. Cues that are not near any
passage found form blocks that are reported as unknown license language.

All work on a text stays within its row; nothing is shuffled.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolume.llm.common import map_arrow, worker_state

# Short notices and opening passages of public licenses.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the "
        "License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Neither the name of the copyright holder nor the names of its contributors "
        "may be used to endorse or promote products derived from this software without specific "
        "prior written permission.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
    ),
    "Proprietary": ("All rights reserved.",),
}
CUES = (
    r"(?i:licen[sc]e|copyright|warrant|public[\W_]+domain|all[\W_]+rights[\W_]+reserved|"
    r"hereby[\W_]+granted|redistribut|sublicen|creative[\W_]+commons|\bCC[\W_]+BY\b|"
    r"apache\.org|mozilla\.org|permission[\W_]+notice|merchantability)"
)
GAP_LINES, GAP_WORDS = 2, 60  # between cues of one block: lines without a cue, and words
LEAST_SAVED = 0.2  # share of the passage's bytes
LONGEST = round(1 / LEAST_SAVED)  # a passage of more times the template's words can't save that
MOST_MISSING = 0.1  # share of the template's words
# Extra words that a missing word is worth: a close alignment first, then ones of fewer missing.
WEIGHTS = (1, 10, 400)
# A hyphen at the end of a line joins as one within a line does.
WORD = re.compile(r"[^\W_]+(?:(?:[.']|-(?:\s*\n[\W_]*)?)[^\W_]+)*")
WRAPPED = re.compile(r"-\s*\n[\W_]*")
SCALE = 1 << 20  # of a packed cost: the missing words are below

BLOCKS = (
    "doc_id long, first_line long, last_line long, license string, status string, "
    "saved double, missing long, extra long, wording string"
)


def words_of(text: str) -> tuple[list[str], list[int]]:
    """The words in lower case, and where they begin."""
    words, starts = [], []
    for m in WORD.finditer(text):
        word = m[0].lower()
        words.append(WRAPPED.sub("-", word) if "\n" in word else word)
        starts.append(m.start())
    return words, starts


def runs_of(places: list[int], near) -> list[tuple[int, int]]:
    """First and last of each run of sorted places; ``near`` tells whether two are linked."""
    out: list = []
    for i in places:
        if out and near(out[-1][1], i):
            out[-1][1] = i
        else:
            out.append([i, i])
    return [tuple(b) for b in out]


def costs(wanted: np.ndarray, words: np.ndarray, weight: int) -> Iterator[np.ndarray]:
    """For each beginning of ``wanted``, the least packed cost of aligning it with words that
    end before each place: ``weight`` and 1 below for each missing word, 1 for each extra
    word in between. Words before the first aligned one are free."""
    n = len(words)
    ramp = np.arange(n + 1, dtype=np.int64) * SCALE
    row = np.zeros(n + 1, np.int64)
    yield row
    for w in wanted:
        new = row + (weight * SCALE + 1)
        new[1:] = np.where(words == w, np.minimum(new[1:], row[:-1]), new[1:])
        row = np.minimum.accumulate(new - ramp) + ramp
        yield row


class Template:
    def __init__(self, name: str, text: str, ids: dict[str, int]):
        self.name = name
        self.words = words_of(text)[0]
        self.ids = np.array([ids.setdefault(w, len(ids)) for w in self.words])
        self.needs = Counter(self.ids.tolist())
        self.most_missing = int(MOST_MISSING * len(self.words))
        # a dictionary of a few bytes is refused: it is repeated up to 64
        data = " ".join(self.words).encode()
        data *= -(-64 // len(data))
        raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=raw)

    def may_hold(self, words: np.ndarray) -> bool:
        """Whether enough of the template's words occur at all."""
        have = Counter(words[words >= 0].tolist())
        common = sum(min(n, have[w]) for w, n in self.needs.items())
        return common >= len(self.words) - self.most_missing

    def passages(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(begin, end, missing, extra, weight) of alignments that don't overlap."""
        size, out = len(self.words), []
        taken = np.zeros(len(words), bool)
        for weight in WEIGHTS:
            for last in costs(self.ids, words, weight):
                pass
            missing = last % SCALE
            extra = last // SCALE - weight * missing
            spans = size - missing + extra
            ends = np.flatnonzero((missing <= self.most_missing) & (spans <= LONGEST * size))
            for end in ends[np.argsort(last[ends], kind="stable")].tolist():
                begin = end - int(spans[end])
                if not taken[begin:end].any():
                    taken[begin:end] = True
                    out.append((begin, end, int(missing[end]), int(extra[end]), weight))
        return out

    def trace(self, words: np.ndarray, weight: int) -> tuple[list[int], list[str]]:
        """Places of the aligned words, and the missing words, of a passage."""
        rows = list(costs(self.ids, words, weight))
        i, j = len(self.ids), len(words)
        places, lost = [], []
        while i:
            if j and words[j - 1] == self.ids[i - 1] and rows[i][j] == rows[i - 1][j - 1]:
                i, j = i - 1, j - 1
                places.append(j)
            elif rows[i][j] == rows[i - 1][j] + weight * SCALE + 1:
                i -= 1
                lost.append(self.words[i])
            else:
                j -= 1
        return places[::-1], lost[::-1]


class Matcher:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.cue = re.compile(CUES)
        self.plain = zstandard.ZstdCompressor(level=9)
        self.ids: dict[str, int] = {}
        self.templates = [
            Template(name, text, self.ids) for name, texts in templates.items() for text in texts
        ]
        self.reach = LONGEST * max((len(t.words) for t in self.templates), default=0)

    def saved(self, words: list[str], template: Template) -> float:
        """Share of the bytes that the template saves."""
        data = " ".join(words).encode()
        return 1 - len(template.compressor.compress(data)) / len(self.plain.compress(data))

    def notices(self, words: list[str]) -> Iterator[tuple]:
        """(begin, end, license, status, saved, missing, extra, wording) of all notices."""
        ids = np.array([self.ids.get(w, -1) for w in words], np.int64)
        left = self.templates
        while left := [t for t in left if t.may_hold(ids)]:
            found = [
                (missing - len(t.words), missing + extra, begin, k, end, missing, extra, weight)
                for k, t in enumerate(left)
                for begin, end, missing, extra, weight in t.passages(ids)
            ]
            taken, some = np.zeros(len(words), bool), False
            for _, _, begin, k, end, missing, extra, weight in sorted(found):
                if taken[begin:end].any():
                    continue
                # words of notices found before are no part of this one
                own = [words[i] for i in range(begin, end) if ids[i] != -2]
                share = self.saved(own, left[k])
                if share < LEAST_SAVED:
                    continue
                places, lost = left[k].trace(ids[begin:end], weight)
                taken[begin:end] = some = True
                ids[[begin + p for p in places]] = -2
                status = "variant" if missing or extra else "exact"
                yield begin, end, left[k].name, status, share, missing, extra, " ".join(lost)
            if not some:
                break

    def rows(self, text: str) -> list[tuple]:
        """first_line, last_line and the other columns, of a text's notices and unknown blocks."""
        words, starts = words_of(text)
        ends = {p for m in self.cue.finditer(text) for p in (m.start(), m.end() - 1)}
        cues = sorted({bisect_right(starts, p) - 1 for p in ends})
        breaks = [m.start() for m in re.finditer("\n", text)]
        out, held = [], []  # held: first and last word of each notice
        for first, last in runs_of(cues, lambda a, b: b - a <= 2 * self.reach):
            low = max(first - self.reach, 0)
            for begin, end, *found in self.notices(words[low : last + self.reach + 1]):
                held.append((low + begin, low + end - 1))
                out.append((*held[-1], *found))
        line = [bisect_left(breaks, start) for start in starts]
        # a cue belongs to a notice that it is in a row with
        marks = [(i, i, False) for i in cues] + [(first, last, True) for first, last in held]
        blocks: list = []
        for first, last, known in sorted(marks):
            if (
                blocks
                and line[first] - line[blocks[-1][1]] - 1 <= GAP_LINES
                and first - blocks[-1][1] <= GAP_WORDS
            ):
                blocks[-1][1:] = max(blocks[-1][1], last), blocks[-1][2] or known
            else:
                blocks.append([first, last, known])
        lines = [(line[first], line[last], *found) for first, last, *found in out]
        for first, last, known in blocks:
            if not known:
                low = max(first - GAP_WORDS, bisect_left(line, line[first]))
                high = min(last + 1 + GAP_WORDS, bisect_right(line, line[last]))
                share = max((self.saved(words[low:high], t) for t in self.templates), default=0.0)
                lines.append((line[first], line[last], "unknown", "unconfirmed", share, 0, 0, ""))
        return sorted(lines)


def license_blocks(
    documents: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES
) -> DataFrame:
    """One row per notice found, and per block of license language without one near it: doc_id,
    first_line, last_line (from 0), license (``unknown`` for such a block), status (exact,
    variant, unconfirmed), saved (share of bytes that the template saves; of an unknown block,
    the best one), missing and extra words, and the missing wording. Notices on one line, or
    within words that another has in between, get rows of their own.

    Null and empty texts, and texts without license language, give no row. Repeated rows and
    rows with a null id give rows of their own. Equally good notices go by place, then by the order of templates.
    Only ``doc_id`` and ``text`` are read; other columns may have any name.
    """
    key = uuid.uuid4().hex
    chosen = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(
        F.col("text").rlike(CUES)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = worker_state(key, lambda: Matcher(templates))
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(doc_id, *row) for row in matcher.rows(text)]
            names = [f.split()[0] for f in BLOCKS.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
            types = [kinds[f.split()[1]] for f in BLOCKS.split(", ")]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names
            )

    return map_arrow(chosen, run, BLOCKS)
