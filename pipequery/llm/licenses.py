"""License scans by template-markup matching.

A template is license wording with ``<<beginOptional>> ... <<endOptional>>`` regions and
``<<var;name=...;match=...>>`` places for any words. It is compiled into an automaton over tokens:
literals, branches around optional regions, and loops for replaceable ones. A place in a
text is accepted only if all mandatory wording stands there in order, word for word; a replaceable
region takes any number of words that its ``match`` expression allows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipequery.llm.common import ALNUM, ids_and_texts, text_slices

#: A-Z lowered, what isn't part of a word is a space
FOLD = bytes(int(ALNUM[b]) - 1 if ALNUM[b] else 0x20 for b in range(256))

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public license wording, as templates.
TEMPLATES = {
    "mit": [
        "released under the MIT license",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="what";match=".+">>
        <<beginOptional>>and associated documentation files (the "Software")<<endOptional>>, to deal in <<var;name="which";match=".+">>
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";match=".+">> BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        <<var;name="who";match=".+">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ],
    "apache-2": [
        "licensed under the Apache License <<beginOptional>>Version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at <<var;name="url";match=".+">> Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted
        <<beginOptional>>(subject to the limitations in the disclaimer below)<<endOptional>> provided that the following conditions are met:
        <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.
        <<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="organisation";match=".+">> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.<<endOptional>>
        THIS SOFTWARE IS PROVIDED BY <<var;name="provider";match=".+">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ],
    "gpl-3": [
        """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
        <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3""",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "cc-by-nc": [
        """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution NonCommercial
        <<beginOptional>>4 0<<endOptional>> <<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>>""",
        "licensed under CC BY NC 4 0",
    ],
    "copyright": ['copyright <<beginOptional>>c<<endOptional>> <<var;name="years";match="[0-9]{4}( [0-9]{4})*">> <<var;name="holder";match="([^ ]+ ?){1,8}">> all rights reserved'],
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var)\b((?:[^>]|>(?!>))*)>>")
_MATCH = re.compile(r'''match=(?:"([^"]*)"|'([^']*)')''')


def words_of(text: str | bytes) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text).translate(FOLD).split()


@dataclass
class Automaton:
    """States 0, 1, ...; ``literal[s]`` is ``(word, next)``, ``skip[s]`` are states reached without a word.

    ``free[s]``: a loop on ``s`` that takes any words; it is left for ``s + 1`` if the words that it
    took, folded and joined by spaces, match the expression (None: any words, none too).
    """

    label: str
    literal: dict[int, tuple[bytes, int]] = field(default_factory=dict)
    free: dict[int, str | None] = field(default_factory=dict)
    skip: dict[int, list[int]] = field(default_factory=dict)
    end: int = 0
    size: int = 0  #: literal words, optional ones too
    mandatory: set[bytes] = field(default_factory=set)


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template; it must begin with mandatory wording, and optional regions be closed."""
    out, at, opened, last = Automaton(label), 0, [], 0

    def literals(text: str) -> None:
        nonlocal at
        for word in words_of(text):
            out.literal[at] = (word, at + 1)
            at += 1
            out.size += 1
            if not opened:
                out.mandatory.add(word)

    for mark in _MARK.finditer(template):
        literals(template[last : mark.start()])
        last = mark.end()
        if mark[1] == "beginOptional":
            opened.append(at)
        elif mark[1] == "endOptional":
            out.skip.setdefault(opened.pop(), []).append(at)
        else:
            if at in out.free or at in out.skip:  # a loop has a state of its own
                out.skip.setdefault(at, []).append(at + 1)
                at += 1
            given = _MATCH.search(mark[2])
            match = (given[1] if given[1] is not None else given[2]) if given else ".*"
            out.free[at] = None if match in (".*", ".+", "(.*)", "(.+)") else match
            at += 1
    literals(template[last:])
    out.end = at
    if opened or 0 not in out.literal or 0 in out.skip:
        raise ValueError(f"a template of {label} doesn't begin with mandatory wording or leaves a region open")
    return out


def find_template(words: list[bytes], a: Automaton) -> list[tuple[int, int, int]]:
    """``(first word, end, literal words met)`` of the places that ``a`` accepts, in one pass over the words.

    All places where it may begin run at once. Of runs in the same state the one that began first goes
    on; the time is that of the words times the states in use. A place ends at the first word that
    completes it, or at the last one that its last optional regions then take. Places don't overlap.
    """
    import regex

    tail = max(a.free, default=-1)  # states behind the last loop
    found: list[tuple[int, int, int]] = []
    upto = 0
    now: dict[tuple[int, int], tuple[int, int, int]] = {}  # (state, where its loop began): (first word, where the last loop was left, -literal words met)
    best: tuple[int, int, int] | None = None

    def enter(to: dict, state: int, run: tuple[int, int, int], at: int) -> None:
        key = (state, at if a.free.get(state) else -1)
        if key in to and to[key] <= run:
            return
        to[key] = run
        for t in a.skip.get(state, ()):
            enter(to, t, run, at)
        if state in a.free and (a.free[state] is None or regex.fullmatch(a.free[state], "")):
            leave(to, state, run, at)

    def leave(to: dict, state: int, run: tuple[int, int, int], at: int) -> None:
        enter(to, state + 1, (run[0], at, run[2]) if state == tail else run, at)

    for at in range(len(words) + 1):
        ended = min((run for (s, _), run in now.items() if s == a.end), default=None)
        if ended is not None and (best is None or ended[0] <= best[0]):
            best = (ended[0], at, -ended[2])
            now = {k: run for k, run in now.items() if k[0] > tail and run[0] == ended[0] and run[1] <= ended[1]}
        if best is not None and not any(s != a.end for s, _ in now):
            found.append(best)
            upto, best, now = best[1], None, {}
        if at == len(words):
            break
        word, after = words[at], {}
        for (s, began), run in now.items():
            if s in a.literal and a.literal[s][0] == word:
                enter(after, a.literal[s][1], (run[0], run[1], run[2] - 1), at + 1)
            if s in a.free:
                if a.free[s] is None:
                    after[(s, -1)] = min(run, after.get((s, -1), run))
                    leave(after, s, run, at + 1)
                else:
                    taken = b" ".join(words[began : at + 1]).decode("utf-8", "replace")
                    part = regex.fullmatch(a.free[s], taken, partial=True, flags=regex.IGNORECASE)
                    if part is not None:  # it may still become a match
                        after[(s, began)] = run
                    if part is not None and not part.partial:
                        leave(after, s, run, at + 1)
        if best is None and at >= upto and a.literal[0][0] == word:
            enter(after, a.literal[0][1], (at, 0, -1), at + 1)
        if best is not None and not after:
            found.append(best)
            upto, best = best[1], None
            if at >= upto and a.literal[0][0] == word:
                enter(after, a.literal[0][1], (at, 0, -1), at + 1)
        now = after
    if best is not None:
        found.append(best)
    return found


def find_all(words: list[bytes], automata: list[Automaton]) -> list[tuple[str, int, int, float]]:
    """``(label, first word, end, share of the template's wording)`` of each place an automaton accepts."""
    have = set(words)
    return [(a.label, first, end, n / a.size) for a in automata if a.mandatory <= have for first, end, n in find_template(words, a)]


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each of ``docs(doc_id, text, ...)``: counts of words and phrases, labels, a score, and the places.

    ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places)``; places
    are ``(label, first, end)`` in words, of phrases and templates. The score is the largest share of
    a template's wording that stands in the text, 0.5 at least where a phrase does, 0 without labels.
    A null or empty text has no words. Repeated rows and null ids are rows like others; other columns
    are ignored; an empty table gives no rows.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    runs = [(tuple(words_of(p)), label) for p, label in phrases.items()]
    automata = [compile_template(label, t) for label, ts in templates.items() for t in ts]
    # a text is worth splitting into words if all mandatory words of something occur in it as bytes
    needs = sorted({tuple(sorted(set(w), key=lambda x: -len(x))) for w, _ in runs} | {tuple(sorted(a.mandatory, key=lambda x: -len(x))) for a in automata})

    def scan(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for _, data, ends in text_slices(batch.column(1)):
                word = ALNUM[data] != 0
                begins = word.copy()
                begins[1:] &= ~word[:-1]
                cuts = ends[ends < len(data)]
                begins[cuts] = word[cuts]
                upto = np.concatenate([[0], np.searchsorted(np.flatnonzero(begins), ends)])
                low, start = data.tobytes().translate(FOLD), 0
                for row, end in enumerate(ends):
                    n_words = int(upto[row + 1] - upto[row])
                    text = low[start:end]
                    start = end
                    places, share = [], 0.0
                    if any(all(w in text for w in need) for need in needs):
                        words = text.split()
                        for run, label in runs:
                            places += [(at, at + len(run), label, True) for at, w in enumerate(words) if w == run[0] and tuple(words[at : at + len(run)]) == run]
                        for label, at, to, part in find_all(words, automata):
                            places.append((at, to, label, False))
                            share = max(share, part)
                    base = [p for p in places if p[3]]
                    if base:
                        share = max(share, 0.5)
                    firsts = [p[0] for p in base]
                    values = (n_words, len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({p[2] for p in base})),
                              ",".join(sorted({p[2] for p in places})), share, [{"label": p[2], "first": p[0], "end": p[1]} for p in sorted(places)])
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
            place = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), place]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "places array<struct<label: string, first: bigint, end: bigint>>"
    )
    return ids_and_texts(docs).mapInArrow(scan, schema)
