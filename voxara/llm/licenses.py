"""License scan by template markup (operator 5).

A template is a license's wording with marks: ``<<opt>> ... <</opt>>`` encloses
words that may be absent, ``<<alt>> ... <<or>> ... <</alt>>`` wordings of which
one must stand there, and ``<<var:m>>`` is replaceable by up to m words of the
user's own (names, years). Templates are compiled to nondeterministic automata
over tokens; a place is accepted only if all mandatory words match exactly.
Texts hold a license's whole wording; notices are the short sentences by which
a work refers to a license.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from voxara.llm.common import lean, own_columns

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<alt>>authors or copyright holders<<or>>copyright holders<<or>>authors<</alt>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_GNU = "<<opt>><<alt>>lesser<<or>>affero<<or>>library<</alt>><</opt>> general public license"
_UNDER = "<<alt>>licensed<<or>>released<<or>>distributed<<or>>available<<or>>published<</alt>> under <<opt>>the terms of<</opt>>"
_CC_VERSION = "<<opt>><<alt>>1 0<<or>>2 0<<or>>2 5<<or>>3 0<<or>>4 0<</alt>><</opt>> <<opt>><<alt>>international<<or>>unported<<or>>generic<</alt>><</opt>> <<opt>>public<</opt>> <<opt>>license<</opt>>"
_CC_MORE = "<<opt>><<alt>>sharealike<<or>>share alike<<or>>sa<<or>>noderivatives<<or>>noderivs<<or>>no derivatives<<or>>nd<</alt>><</opt>>"

# The wording of the licenses, in words. Several templates may share a label.
TEXTS: list[tuple[str, str]] = [
    ("mit", "<<opt>>the mit license <<opt>>mit<</opt>><</opt>> <<opt>>copyright <<opt>>c<</opt>> <<var:20>><</opt>> permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software " + _AS_IS),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this <<alt>>file<<or>>work<</alt>> except in compliance with the license you may obtain a copy of the license at <<alt>>http<<or>>https<</alt>> www apache org licenses license 2 0 <<opt>><<alt>>txt<<or>>html<</alt>><</opt>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", f"<<opt>><<alt>>this program<<or>>this library<<or>>this file<<or>>this software<<or>>it<</alt>> is free software<</opt>> you can redistribute it and or modify it under the terms of the gnu {_GNU} as published by the free software foundation either version <<alt>>2<<or>>2 1<<or>>3<</alt>> of the license or at your option any later version <<alt>>this program<<or>>this library<<or>>this file<<or>>this software<<or>>it<</alt>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {_GNU} for more details"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<opt>><<opt>>3<</opt>> neither the name of <<var:15>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<</opt>> this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify <<alt>>and<<or>>or<<or>>and or<</alt>> distribute this software for any purpose with or without fee is hereby granted <<opt>>provided that the above copyright notice and this permission notice appear in all copies<</opt>> the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<alt>>http<<or>>https<</alt>> mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law " + _AS_IS),
]

NOTICES: list[tuple[str, str]] = [
    ("mit", f"<<opt>>this <<alt>>work<<or>>software<<or>>file<<or>>project<<or>>library<</alt>> is<</opt>> {_UNDER} the mit license"),
    ("apache", f"{_UNDER} the apache <<opt>>software<</opt>> license <<opt>>version<</opt>> 2 0"),
    ("gpl", f"{_UNDER} the <<opt>>gnu<</opt>> {_GNU} <<opt>><<opt>>version<</opt>> <<alt>>2<<or>>2 1<<or>>3<</alt>> <<opt>>0<</opt>> <<opt>>or <<opt>>at your option<</opt>> any later version<</opt>><</opt>>"),
    ("bsd", f"{_UNDER} <<alt>>the<<or>>a<</alt>> <<opt>><<alt>>2 clause<<or>>3 clause<</alt>><</opt>> bsd license"),
    ("mpl", f"{_UNDER} the mozilla public license <<opt>><<opt>><<alt>>version<<or>>v<</alt>><</opt>> 2 0<</opt>>"),
    ("cc-by", f"{_UNDER} <<opt>><<alt>>a<<or>>an<<or>>the<</alt>><</opt>> <<alt>>creative commons attribution<<or>>cc by<</alt>> {_CC_MORE} {_CC_VERSION}"),
    ("cc-by-nc", f"{_UNDER} <<opt>><<alt>>a<<or>>an<<or>>the<</alt>><</opt>> <<alt>>creative commons attribution<<or>>cc by<</alt>> <<alt>>noncommercial<<or>>non commercial<<or>>nc<</alt>> {_CC_MORE} {_CC_VERSION}"),
    ("proprietary", "all rights reserved"),
]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_MARK = re.compile(r"<<(opt|alt)>>|<<(or)>>|<<(/opt|/alt)>>|<<var:(\d+)>>|([^<\s]+)")

#: Scores of a license's whole text, of a notice, and of a base phrase alone.
TEXT_SCORE, NOTICE_SCORE, PHRASE_SCORE = 1.0, 0.9, 0.6


class Automaton:
    """A template as states; each state reads a given word, any word, or nothing at all."""

    #: What the step between two alternatives reads; no word has a blank.
    NEVER = " "

    def __init__(self, template: str):
        self.reads: list[str | None] = []  # word of the step from state k to k + 1; None: any word
        self.jumps: dict[int, set[int]] = {}  # steps that read nothing
        opened: list[tuple[str, list[int]]] = []
        for open_, or_, close, var, word in _MARK.findall(template):
            if open_:
                opened.append((open_, [len(self.reads)]))
            elif or_:
                if not opened or opened[-1][0] != "alt":
                    raise ValueError("<<or>> stands outside of alternatives")
                # This alternative ends here; the next one is reached from the start alone.
                begin = opened[-1][1][0]
                opened[-1][1].append(len(self.reads))
                self.reads.append(self.NEVER)
                self.jumps.setdefault(begin, set()).add(len(self.reads))
            elif close:
                if not opened or "/" + opened[-1][0] != close:
                    raise ValueError("regions are not nested")
                kind, (begin, *ends) = opened.pop()
                for k in [begin] if kind == "opt" else ends:
                    self.jumps.setdefault(k, set()).add(len(self.reads))
            elif var:
                first, after = len(self.reads), len(self.reads) + int(var)
                for k in range(first, after):
                    self.jumps.setdefault(k, set()).add(after)
                    self.reads.append(None)
            else:
                self.reads.append(word.lower())
        if opened:
            raise ValueError("a region isn't closed")
        self.final = len(self.reads)
        first = self.closure({0})
        if self.final in first or any(self.reads[k] is None for k in first):
            raise ValueError("a template must begin with a mandatory or optional word, and hold one")
        self.first = {self.reads[k] for k in first} - {self.NEVER}

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for k in self.jumps.get(todo.pop(), ()):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return seen

    def match(self, words: list[str], at: int) -> int | None:
        """End of the longest match that begins at the word, or None."""
        states, end = self.closure({0}), None
        for i in range(at, len(words)):
            word = words[i]
            states = {k + 1 for k in states if k < self.final and (self.reads[k] is None or self.reads[k] == word)}
            if not states:
                break
            states = self.closure(states)
            if self.final in states:
                end = i + 1
        return end


class Scanner:
    """All templates and phrases, with the places to try found by their first words."""

    def __init__(self, texts: list[tuple[str, str]], notices: list[tuple[str, str]], phrases: dict[str, str]):
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.automata = [(label, Automaton(t), score) for kind, score in ((texts, TEXT_SCORE), (notices, NOTICE_SCORE)) for label, t in kind]
        self.starts: dict[str, list[int]] = {}
        for k, (_, a, _) in enumerate(self.automata):
            for w in a.first:
                self.starts.setdefault(w, []).append(k)
        self.heads: dict[str, list[int]] = {}
        for k, (p, _) in enumerate(self.phrases):
            self.heads.setdefault(p[0], []).append(k)
        self.watched = set(self.starts) | set(self.heads)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """Number of words, base places as (start, end, label) in words, and accepted template places with their scores."""
        words = _WORD.findall(text.translate(_LOWER))
        base, found = [], []
        if not self.watched.isdisjoint(words):
            for i, w in enumerate(words):
                if w not in self.watched:
                    continue
                for k in self.heads.get(w, ()):
                    phrase, label = self.phrases[k]
                    if words[i : i + len(phrase)] == phrase:
                        base.append((i, i + len(phrase), label))
                for k in self.starts.get(w, ()):
                    label, automaton, score = self.automata[k]
                    end = automaton.match(words, i)
                    if end is not None:
                        found.append((i, end, label, score))
        return len(words), base, found


def scan_licenses(docs: DataFrame, license_texts: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """License places of every document.

    A null or empty text has no words and no places, score 0. Repeated rows
    each give a row; columns besides doc_id and text are not looked at.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (that of the best evidence: a whole text, a notice, a phrase
    alone; else 0) and places (``label:start:end``, comma-joined).
    """
    license_texts, notices, phrases = license_texts or TEXTS, notices or NOTICES, phrases or PHRASES
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("places", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(license_texts, notices, phrases)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, base, found = scanner.scan(text or "")
                own = sorted({label for *_, label in base})
                labels = sorted({label for _, _, label, _ in found} | set(own))
                score = max([x for *_, x in found], default=PHRASE_SCORE if base else 0.0)
                starts = [s for s, *_ in base]
                places = ",".join(f"{label}:{s}:{e}" for s, e, label, _ in sorted(found))
                out.append((doc_id, n, len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(labels), score, places))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return own_columns(docs, "doc_id", "text").mapInArrow(lean(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places string")
