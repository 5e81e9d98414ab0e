"""License scans by template markup.

A template is mandatory wording with optional regions ``[[ ... ]]`` and replaceable ones ``<<n>>`` (one to n
words); ``(( a | b ))`` wants one of its branches. It is compiled into a token automaton; a text matches where the automaton accepts, which needs all the
mandatory wording, word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, outer_id

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_MIT = """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial
portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the
warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<8>> be liable for any claim damages
or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
other dealings in the software
"""
_ISC = """
permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
copyright notice and this permission notice appear in all copies the software is provided as is and <<3>> disclaims all warranties with
regard to this software including all implied warranties of merchantability and fitness in no event shall <<3>> be liable for any special
direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of
contract negligence or other tortious action arising out of or in connection with the use or performance of this software
"""
_BSD_GRANT = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[ 1 ]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[[ 2 ]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution
"""
_BSD_NAMES = """
[[ 3 ]] neither the name of <<12>> nor the names of <<4>> contributors may be used to endorse or promote products derived from this software
without specific prior written permission
"""
_BSD_WARRANTY = """
this software is provided by <<8>> as is and any express or implied warranties including but not limited to the implied warranties of
merchantability and fitness for a particular purpose are disclaimed in no event shall <<8>> be liable for any direct indirect incidental
special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or
profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including
negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage
"""
_APACHE = """
licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a
copy of the license at (( http | https )) www apache org licenses license 2.0 unless required by applicable law or agreed to in writing
software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or
implied see the license for the specific language governing permissions and limitations under the license
"""
_GPL = """
<<6>> is free software you can redistribute it and or modify it under the terms of the gnu {kind} general public license as published by the
free software foundation either version <<2>> of the license or at your option any later version <<6>> is distributed in the hope that it
will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
{kind} general public license for more details
"""
_MPL = """
this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file
you can obtain one at (( http | https )) mozilla org mpl 2.0
"""
_USED = "(( licensed | released | distributed | available | published ))"

#: (label, template, score): whole texts and file headers first, then notices of one line.
TEMPLATES = (
    ("mit", _MIT, 1.0),
    ("isc", _ISC, 1.0),
    ("bsd-2-clause", _BSD_GRANT + _BSD_WARRANTY, 1.0),
    ("bsd-3-clause", _BSD_GRANT + _BSD_NAMES + _BSD_WARRANTY, 1.0),
    ("apache-2.0", _APACHE, 1.0),
    ("gpl-text", _GPL.replace("{kind}", ""), 1.0),
    ("lgpl-text", _GPL.replace("{kind}", "(( lesser | library ))"), 1.0),
    ("agpl-text", _GPL.replace("{kind}", "affero"), 1.0),
    ("mpl-2.0", _MPL, 1.0),
    ("apache-2.0-notice", "licensed under the apache license version 2.0", 0.8),
    ("mit-notice", f"{_USED} under the [[ terms of the ]] mit license", 0.8),
    ("bsd-notice", f"{_USED} under the [[ <<2>> clause ]] bsd license", 0.8),
    ("gpl-versioned", "gnu [[ lesser | affero ]] general public license [[ as published by the free software foundation ]] [[ either ]] version <<1>>", 0.8),
    ("gpl-notice", f"{_USED} under the gnu [[ lesser | affero ]] general public license", 0.8),
    ("cc-by-nc", f"{_USED} under [[ a | the ]] cc by nc", 0.8),
    ("cc-by-sa", f"{_USED} under [[ a | the ]] cc by sa", 0.8),
    ("creative-commons", f"{_USED} under a creative commons <<6>> license", 0.8),
    ("mpl-2.0-notice", "subject to the terms of the mozilla public license [[ v | version ]] 2.0", 0.8),
    ("copyright-notice", "copyright [[ c ]] [[ <<2>> by ]] <<8>> all rights reserved", 0.8),
    ("public-domain", "dedicated to the public domain", 0.8),
)
#: A notice after one of these words says the contrary.
DENIED = frozenset((b"not", b"never", b"longer", b"isn", b"t"))

_SPACE = bytes(32 if x < 0x30 or 0x3A <= x <= 0x40 or 0x5B <= x <= 0x60 or 0x7B <= x <= 0x7F else x for x in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    """A-Z in lower case; words are runs of digits, letters and bytes from 0x80 on."""
    return text.translate(_SPACE).split()


class TokenAutomaton:
    """States with edges by word, edges for any word, and empty moves."""

    def __init__(self, template: str):
        self.by_word: list[dict[bytes, set[int]]] = [{}]
        self.any_word: list[set[int]] = [set()]
        self.empty: list[set[int]] = [set()]
        self.mandatory: list[bytes] = []
        tokens = re.findall(r"\[\[|\]\]|\(\(|\)\)|\||<<\d+>>|[^\s\[\]()<>|]+", template)
        self.last, _ = self._sequence(0, tokens, 0, 0)
        self.closure = [self._close(s) for s in range(len(self.empty))]
        self.starts = {w for s in self.closure[0] for w in self.by_word[s]}
        self.open_start = any(self.any_word[s] for s in self.closure[0])

    def _state(self) -> int:
        self.by_word.append({})
        self.any_word.append(set())
        self.empty.append(set())
        return len(self.empty) - 1

    def _sequence(self, state: int, tokens: list[str], at: int, depth: int) -> tuple[int, int]:
        begin, ends = state, []
        while at < len(tokens):
            token, at = tokens[at], at + 1
            if token in ("]]", "))"):
                break
            if token == "|":
                ends.append(state)
                state = self._state()
                self.empty[begin].add(state)
            elif token in ("[[", "(("):
                inner = self._state()
                self.empty[state].add(inner)
                end, at = self._sequence(inner, tokens, at, depth + 1)
                after = self._state()
                self.empty[end].add(after)
                if token == "[[":
                    self.empty[state].add(after)
                state = after
            elif token.startswith("<<"):
                most = int(token[2:-2])
                after = self._state()
                for _ in range(most):
                    nxt = self._state()
                    self.any_word[state].add(nxt)
                    self.empty[nxt].add(after)
                    state = nxt
                state = after
            else:
                for word in words_of(token.encode()):
                    nxt = self._state()
                    self.by_word[state].setdefault(word, set()).add(nxt)
                    state = nxt
                    if not depth:
                        self.mandatory.append(word)
        if ends:
            after = self._state()
            for end in [*ends, state]:
                self.empty[end].add(after)
            state = after
        return state, at

    def _close(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def accepts_at(self, words: list[bytes], at: int) -> bool:
        states = self.closure[0]
        for i in range(at, len(words) + 1):
            if self.last in states:
                return True
            if i == len(words):
                return False
            reached = set()
            for s in states:
                reached |= self.any_word[s] | self.by_word[s].get(words[i], set())
            if not reached:
                return False
            states = frozenset().union(*(self.closure[s] for s in reached))
        return False

    def found_in(self, words: list[bytes]) -> bool:
        return any((self.open_start or w in self.starts) and not (i and words[i - 1] in DENIED) and self.accepts_at(words, i) for i, w in enumerate(words))


def _scan(templates: tuple[tuple[str, str, float], ...]):
    phrases = [(label, b" " + phrase.encode() + b" ", len(phrase.split())) for phrase, label in BASE]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = [(label, TokenAutomaton(t), worth) for label, t, worth in templates]
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                words = words_of(text)
                line = b" " + b" ".join(words) + b" "
                places, base = [], set()
                for label, phrase, _ in phrases:
                    at, seen, nth = line.find(phrase), 0, 0
                    while at >= 0:
                        nth += line.count(b" ", seen, at)
                        seen = at
                        places.append(nth)
                        base.add(label)
                        at = line.find(phrase, at + 1)
                found = {label: worth for label, a, worth in automata if all(b" " + w + b" " in line for w in a.mandatory) and a.found_in(words)}
                labels = base | found.keys()
                score = max([0.5 if base else 0.0, *found.values()])
                out.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            got = pd.DataFrame(out, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            yield got.astype({"first_word": "Int64", "last_word": "Int64"})

    return run


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str, float], ...] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from fixed phrases, further ones from accepted templates. score: that
    of the best template that matches (1 for a whole license text or header, 0.8 for a notice), else 0.5 if a base phrase
    stands there, else 0. A text of any length is read whole, a match may stand anywhere in it. Null text counts as empty; a null doc_id stays null; repeated rows
    are documents of their own; an empty table gives no rows; further columns are ignored. Map-only: whole texts,
    no shuffle.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInPandas(_scan(templates), schema).withColumn("doc_id", outer_id())
