"""License scans: phrases, and templates with optional and replaceable markup.

A template is wording with ``<<beginOptional>>``, ``<<endOptional>>`` and
``<<var;most=N>>`` (any words, N at most) markup. It compiles to an automaton
over words; it accepts a place where all mandatory wording stands exactly, the
optional parts each wholly or not at all, and the replaceable ones with any
words. Only places where the template's opening words stand are tried.

Words are runs of letters, digits and non-ASCII characters; A-Z is folded.

Defined results: a null text is an empty one; no place gives null first and last
words, empty labels and score 0; extra columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_bytes

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The whole wording of short licenses; their labels differ from those of notices.
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_THIRD = " <<beginOptional>>3<<endOptional>> neither the name of <<var;most=20>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_END = (
    " this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    " in no event shall the copyright <<var;most=4>> or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption"
    " however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GPL = "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"

# Templates of public license notices, by SPDX identifier, and of whole texts, by the identifier and "-text".
TEMPLATES = {
    "MIT": [
        "released under the <<beginOptional>>terms of the<<endOptional>> mit license",
        "licensed under the <<beginOptional>>terms of the<<endOptional>> mit license",
    ],
    "Apache-2.0": ["licensed under the apache license version 2 0", "licensed under apache <<beginOptional>>license<<endOptional>> 2 0"],
    "GPL-3.0": [
        "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>>"
        " <<beginOptional>>either<<endOptional>> version 3",
        _GPL + " <<beginOptional>>either<<endOptional>> version 3",
    ],
    "CC-BY-NC-4.0": ["licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> <<var;most=3>> cc by nc 4 0"],
    "GPL-2.0": [_GPL + " <<beginOptional>>either<<endOptional>> version 2"],
    "MIT-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software " + _WARRANTY
    ],
    "BSD-2-Clause-text": [_BSD + _BSD_END],
    "BSD-3-Clause-text": [_BSD + _THIRD + _BSD_END],
    "ISC-text": [
        "permission to use copy modify <<beginOptional>>and<<endOptional>> <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever"
        " resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_MARK = re.compile(r"<<([^>]*)>>|([^<\s]+)")


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_FOLD).split() if raw else []


class Template:
    """``lead``: the opening words; ``edges[state]``: (word or None for any, next state); ``skips[state]``: states reached without a word."""

    def __init__(self, markup: str):
        self.edges, self.skips, self.lead, plain, opened = [[]], [[]], [], True, None

        def state() -> int:
            self.edges.append([])
            self.skips.append([])
            return len(self.edges) - 1

        at = 0
        for mark, word in _MARK.findall(markup):
            if word:
                token = word.encode().translate(_FOLD)
                if plain:
                    self.lead.append(token)
                new = state()
                self.edges[at].append((token, new))
                at = new
                continue
            plain = False
            if mark == "beginOptional":
                if opened is not None:
                    raise ValueError("optional parts do not nest")
                opened = at
            elif mark == "endOptional":
                self.skips[opened].append(at)
                opened = None
            else:
                first, new = at, at
                for _ in range(int(re.search(r"most=(\d+)", mark)[1])):
                    new = state()
                    self.edges[at].append((None, new))
                    at = new
                for s in range(first, new):
                    self.skips[s].append(new)
        self.final = at
        if not self.lead or opened is not None:
            raise ValueError("a template starts with mandatory words and closes its optional parts")

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes], start: int) -> bool:
        """Whether the wording stands from word ``start`` on."""
        states = self._closure({0})
        for i in range(start, len(words) + 1):
            if self.final in states:
                return True
            if not states or i == len(words):
                return False
            states = self._closure({t for s in states for w, t in self.edges[s] if w is None or w == words[i]})
        return False


def template_regex(markup: str) -> str:
    """The same wording as a regular expression over words each followed by one space."""
    out = ""
    for mark, word in _MARK.findall(markup):
        out += word + " " if word else "(?:" if mark == "beginOptional" else ")?" if mark == "endOptional" else "(?:[^ ]+ ){0,%s}" % re.search(r"most=(\d+)", mark)[1]
    return out


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers where the phrase (words joined by spaces, one at each end) stands in ``joined`` (the same of a text)."""
    out, at, seen, number = [], joined.find(phrase), 0, 0
    while at >= 0:
        number += joined.count(b" ", seen, at)
        seen = at
        out.append(number)
        at = joined.find(phrase, at + 1)
    return out


def _scan_rows(phrases: dict[str, str], templates: dict[str, list[str]]):
    def run(batches):
        wanted = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        automata = [(label, t, b" " + b" ".join(t.lead) + b" ") for label, markups in templates.items() for t in map(Template, markups)]
        for batch in batches:
            out = []
            for t in text_bytes(batch.column("text")):
                words = words_of(t)
                joined = b" " + b" ".join(words) + b" "
                found = {label: got for p, label in wanted if (got := places(joined, p))}
                own = sorted({label for label, a, lead in automata if lead in joined and any(a.accepts(words, i) for i in places(joined, lead))})
                starts = sorted(i for got in found.values() for i in got)
                out.append((len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, sorted(found), own))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "phrase_labels", "template_labels"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, places of the phrases and the labels found by phrase and by template."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, phrase_labels array<string>, template_labels array<string>"
    return id_text(docs, id_col, text_col).mapInArrow(_scan_rows(phrases, templates), schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: joined labels, and a score of 1 for a template, 0.5 for phrases alone, else 0."""
    both = F.array_sort(F.array_union("phrase_labels", "template_labels"))
    score = F.when(F.size("template_labels") > 0, 1.0).when(F.col("n_base") > 0, 0.5).otherwise(0.0)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("phrase_labels", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))
