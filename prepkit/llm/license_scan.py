"""Operator 1: license scans by template markup.

A license notice is a template: plain words are mandatory, ``<<beginOptional>> ...
<<endOptional>>`` may be missing, and ``<<var;words=LO-HI>>`` stands for LO to HI words
of any kind.  Each template is compiled to an automaton over word tokens.  Only
texts that hold two mandatory neighbour words of a template (found by comparing
word hashes of the whole batch at once) are run through its automaton, and a text
is accepted where all mandatory wording stands exactly and in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.llm import textcols as T

#: phrases of the base scan, by label (fixed values of the contract)
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: own templates, by label; words as the scan sees them (digits, a-z, beyond ASCII)
TEMPLATES = {
    "mit": [
        "under the <<beginOptional>>terms of the<<endOptional>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of "
        "<<var;words=1-12>> documentation files",
    ],
    "apache-2.0": [
        "under the <<beginOptional>>terms of the<<endOptional>> apache license "
        "<<beginOptional>>version<<endOptional>> 2 0",
    ],
    "gpl-2.0": ["gnu general public license <<var;words=0-8>> version 2"],
    "gpl-3.0": ["gnu general public license <<var;words=0-8>> version 3"],
    "lgpl": ["gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>library<<endOptional>> "
             "lesser general public license", "gnu lesser general public license", "gnu library general public license"],
    "agpl-3.0": ["gnu affero general public license <<var;words=0-8>> version 3"],
    "cc-by-4.0": ["cc by 4 0", "creative commons attribution 4 0 <<beginOptional>>international<<endOptional>> license"],
    "cc-by-sa-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0"],
    "cc-by-nc-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0"],
    "cc-by-nc-sa-4.0": ["cc by nc sa 4 0"],
    "cc0-1.0": ["cc0 1 0 <<beginOptional>>universal<<endOptional>>"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"],
    "mpl-2.0": ["mozilla public license <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 2 0"],
    "copyright": ["copyright <<var;words=1-12>> all rights reserved"],
}

_PART = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>|([0-9a-z\u0080-\U0010ffff]+)")


@dataclass
class Automaton:
    """States 0..n; ``moves[s]`` has (word or None for any word, next state)."""

    label: str
    moves: list[list[tuple[str | None, int]]]
    skips: list[list[int]]
    final: int
    anchor: tuple[str, str]   #: two mandatory neighbour words
    reach: int                #: most words of a match


def compile_template(label: str, text: str) -> Automaton:
    moves: list[list[tuple[str | None, int]]] = [[]]
    skips: list[list[int]] = [[]]
    opened: list[int] = []
    plain: list[tuple[str, bool]] = []      # (word, whether its predecessor is mandatory and next to it)
    state, reach, joined = 0, 0, False

    def grow(word: str | None) -> int:
        moves.append([])
        skips.append([])
        moves[state].append((word, len(moves) - 1))
        return len(moves) - 1

    for m in _PART.finditer(text):
        kind, lo, hi, word = m.groups()
        if word:
            state = grow(word)
            reach += 1
            if not opened:
                plain.append((word, joined))
                joined = True
        elif kind == "beginOptional":
            opened.append(state)
            joined = False
        elif kind == "endOptional":
            skips[opened.pop()].append(state)
            joined = False
        else:
            for i in range(int(hi)):
                before = state
                state = grow(None)
                if i >= int(lo):
                    skips[before].append(state)
            reach += int(hi)
            joined = False
    pairs = [(a[0], b[0]) for a, b in zip(plain, plain[1:]) if b[1]]
    if opened or not pairs:
        raise ValueError(f"template of {label}: unbalanced, or without two mandatory neighbour words")
    # of the possible anchors, the one with the longest words is the rarest guess
    return Automaton(label, moves, skips, state, max(pairs, key=lambda p: len(p[0]) + len(p[1])), reach)


class Scanner:
    """Automata with their words replaced by word hashes."""

    def __init__(self, templates: dict[str, list[str]], base: dict[str, str]):
        self.base = {label: [int(T.word_hash(w)) for w in phrase.split()] for label, phrase in base.items()}
        self.automata = [compile_template(label, t) for label, ts in templates.items() for t in ts]
        self.steps = []
        for a in self.automata:
            hashed = [[(None if w is None else int(T.word_hash(w)), to) for w, to in m] for m in a.moves]
            self.steps.append((hashed, [self._closure(a, s) for s in range(len(a.moves))]))
        self.anchors = np.array([self._pair(*(T.word_hash(w) for w in a.anchor)) for a in self.automata], np.uint64)

    @staticmethod
    def _pair(a, b):
        return T.mix(np.atleast_1d(a) * T.PLACE_KEY[0] + np.atleast_1d(b) * T.PLACE_KEY[1])[0]

    @staticmethod
    def _closure(a: Automaton, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for nxt in a.skips[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    def accepts(self, which: int, words: list[int]) -> list[tuple[int, int]]:
        """(first, last) word of the matches of one automaton that end in ``words``, longest start first."""
        moves, closure = self.steps[which]
        final, out = self.automata[which].final, []
        now: dict[int, int] = {}                  # state -> earliest start
        for i, word in enumerate(words):
            for s in closure[0]:
                now.setdefault(s, i)
            then: dict[int, int] = {}
            for s, start in now.items():
                for expected, to in moves[s]:
                    if expected is None or expected == word:
                        for c in closure[to]:
                            then[c] = min(start, then.get(c, start))
            if final in then:
                out.append((then[final], i))
            now = then
        return out

    def base_places(self, words: T.Words) -> list[tuple[str, np.ndarray]]:
        """Per phrase the places (of all words together) where it stands within one text."""
        text, out = words.text_of(), []
        for label, phrase in self.base.items():
            n = len(words.hash) - len(phrase) + 1
            hit = np.ones(max(n, 0), bool)
            for j, h in enumerate(phrase):
                hit &= words.hash[j:j + max(n, 0)] == np.uint64(h)
            place = np.flatnonzero(hit)
            out.append((label, place[text[place] == text[place + len(phrase) - 1]]))
        return out

    def matches(self, words: T.Words) -> list[tuple[int, str, int, int]]:
        """(text, label, first, last word) of the accepted templates; words counted from 0 in their text."""
        if len(words.hash) < 2:
            return []
        pair, text = T.windows(words, 2)
        found = np.flatnonzero(np.isin(pair, self.anchors))
        at = np.searchsorted(text, np.arange(len(words.first)))
        regions: dict[tuple[int, int], list[list[int]]] = {}
        for p in found:
            i = int(text[p])
            place = int(p - at[i])
            for which in np.flatnonzero(self.anchors == pair[p]):
                reach = self.automata[which].reach
                lo = max(0, place - reach)
                hi = min(int(words.counts[i]), place + reach + 1)
                spans = regions.setdefault((i, int(which)), [])
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
        out = []
        for (i, which), spans in regions.items():
            for lo, hi in spans:
                part = words.hash[words.first[i] + lo:words.first[i] + hi].tolist()
                out += [(i, self.automata[which].label, lo + a, lo + b) for a, b in self.accepts(which, part)]
        return out


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None,
                 base: dict[str, str] | None = None) -> DataFrame:
    """documents(doc_id, text) -> one row per document with every place of every notice.

    doc_id, n_words long, n_base long, first_word, last_word long, base_labels string,
    labels string (sorted, comma-joined), score double (1 if a template is accepted, 0.5
    if only a base phrase stands there, else 0), matches array<struct<label, first_word,
    last_word>> of the templates.  Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z
    lower-cased.  Null and empty texts have no words; repeated rows and null doc_ids each
    give a row; other columns are ignored.
    """
    templates, base = templates or TEMPLATES, base or BASE
    for label, texts in templates.items():
        for text in texts:
            compile_template(label, text)       # a wrong template fails before the job starts
    match_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for batch in batches:
            data, offs = T.buffers(batch.column(1))
            for lo, hi in T.doc_groups(offs):
                words = T.words_of(data, offs[lo:hi + 1], T.NON_ALNUM, True)
                n = hi - lo
                text = words.text_of()
                n_base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
                base_labels: dict[int, set[str]] = {}
                for label, places in scanner.base_places(words):
                    for p in places:
                        i = int(text[p])
                        k = int(p - words.first[i])
                        n_base[i] += 1
                        first[i] = k if first[i] < 0 else min(first[i], k)
                        last[i] = max(last[i], k)
                        base_labels.setdefault(i, set()).add(label)
                matches: dict[int, list[dict]] = {}
                for i, label, a, b in scanner.matches(words):
                    matches.setdefault(i, []).append({"label": label, "first_word": a, "last_word": b})
                rows = [matches.get(i, []) for i in range(n)]
                own = [base_labels.get(i, set()) for i in range(n)]
                both = [own[i] | {m["label"] for m in rows[i]} for i in range(n)]
                none = first < 0
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, n), pa.array(words.counts, pa.int64()), pa.array(n_base),
                    pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none),
                    pa.array([",".join(sorted(x)) for x in own]), pa.array([",".join(sorted(x)) for x in both]),
                    pa.array([1.0 if rows[i] else 0.5 if own[i] else 0.0 for i in range(n)], pa.float64()),
                    pa.array(rows, match_type)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                     "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double, matches array<struct<label string, first_word long, last_word long>>")


def template_regex(text: str) -> str:
    """The template as a regular expression over words that each follow one space (for the SQL twin)."""
    out = []
    for m in _PART.finditer(text):
        kind, lo, hi, word = m.groups()
        out.append(f" {word}" if word else "(?:" if kind == "beginOptional" else ")?" if kind == "endOptional"
                   else f"(?: [^ ]+){{{lo},{hi}}}")
    return "".join(out) + " "


def oracle_sql() -> str:
    """DuckDB twin over the table documents, for ASCII lower-casing and the templates above."""
    def places(label: str, phrase: str) -> str:
        test = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(phrase.split()))
        return f"list_transform(list_filter(range(len(w)), lambda i: {test}), lambda i: {{'l': '{label}', 'p': i}})"

    base = f"list_concat({', '.join(places(k, v) for k, v in BASE.items())})"
    own = ", ".join(f"CASE WHEN {' OR '.join(f'regexp_matches(s, $${template_regex(t)}$$)' for t in ts)} THEN '{label}' END"
                    for label, ts in TEMPLATES.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {base} AS b FROM t),
v AS (SELECT doc_id, len(w) AS n_words, b, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM u)
SELECT doc_id, n_words, len(b) AS n_base, list_min(list_transform(b, lambda x: x.p)) AS first_word,
       list_max(list_transform(b, lambda x: x.p)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(b, lambda x: x.l))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(b, lambda x: x.l), own))), ',') AS labels,
       CASE WHEN len(own) > 0 THEN 1.0::DOUBLE WHEN len(b) > 0 THEN 0.5 ELSE 0 END AS score FROM v"""
