"""License scans: fuzzy search for short notices.

Texts are folded to words with one space between. A notice of n characters may differ in up to k = n / 12 edits; cut into
k + 1 pieces, each match has a piece unchanged (pigeonhole). One automaton finds all pieces of all notices; around each
such seed the regex library looks for the notice with at most k errors, from the start of a word to the end of one,
and tells span and edits.

What names the licence may not differ: numbers, and the words of `TELLING`, must be those of the notice, in its order,
and no such word may follow that would make it another licence (a further element, or a further number other than 0 after a number).

Base phrases must stand word for word: the counts, places and base labels come from them.

Defined cases: a null text is empty; an empty text has no labels and score 0; of matches of a notice that overlap the one
with fewer edits counts, of equal ones the first; rows that repeat are each scanned; whole texts are scanned,
however long, in time proportional to their length; an empty table gives an empty table; other columns pass through
in `rest` under their own names.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import FOLD_WORDS, parts, per_text, table, unpacked

#: Phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Words that tell licences of one family apart.
TELLING = set("by nc nd sa noncommercial noderivatives noderivs sharealike lesser library affero zero".split())


def creative_commons():
    """Both ways to name each Creative Commons licence, in all its versions."""
    for elements in ("", "nc", "sa", "nd", "nc sa", "nc nd"):
        label = "-".join(["cc-by", *elements.split()])
        long = elements.replace("nc", "noncommercial").replace("sa", "sharealike").replace("nd", "noderivatives")
        yield f"licensed under cc by {elements}".strip(), label
        yield f"licensed under a creative commons attribution {long}".strip(), label
        yield f"creative commons attribution {long}".strip(), label


def versioned():
    """Licences with a version, as they are named in notices."""
    for version, number in (("2 0", "2"), ("1 1", "1.1")):
        yield f"licensed under the apache license version {version}", f"apache-{number}"
        yield f"mozilla public license version {version}", f"mpl-{number}"
        yield f"terms of the mozilla public license v {version}", f"mpl-{number}"
    for version in "23":
        yield f"gnu general public license version {version}", f"gpl-{version}"
        yield f"gnu general public license v{version}", f"gpl-{version}"
        yield f"this work is licensed under the gnu general public license version {version}", f"gpl-{version}"
    for version in "12":
        yield f"eclipse public license version {version} 0", f"epl-{version}"


#: Notices found with errors, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    *versioned(),
    *creative_commons(),
    ("under the terms of the gnu general public license as published by", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu library general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("boost software license version 1 0", "bsl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("creative commons zero", "cc0"),
)
ERRORS_PER_CHARS = 12


def telling(words: list[str]) -> list[str]:
    return [w for w in words if w in TELLING or any("0" <= c <= "9" for c in w)]


class Notice:
    def __init__(self, text: str, label: str, errors_per_chars: int):
        self.text, self.label, self.errors = text, label, len(text) // errors_per_chars
        self.telling = telling(text.split())
        self.pattern = regex.compile(rf"(?b)(?<= )(?:{regex.escape(text)}){{e<={self.errors}}}(?= )")

    def named(self, text: str, start: int, end: int) -> bool:
        """Whether text[start:end] names this licence and no other."""
        if telling(text[start:end].split()) != self.telling:
            return False
        stop = text.find(" ", end + 1)
        following = telling([text[end + 1 : stop if stop > 0 else len(text)]])
        if not following:
            return True
        number = self.telling and self.telling[-1].isdigit() and self.text.endswith(self.telling[-1])
        return following[0] not in TELLING and (not number or following[0] == "0" or not following[0].isdigit())

    def search(self, text: str, start: int, stop: int):
        """Matches inside text[start:stop], the best one and what lies before and after it."""
        todo = [(start, stop)]
        while todo:
            a, b = todo.pop()
            m = self.pattern.search(text, a, b) if b - a >= len(self.text) - self.errors else None
            if m is None:
                continue
            if self.named(text, m.start(), m.end()):
                yield sum(m.fuzzy_counts), m.start(), m.end()
                todo += [(a, m.start()), (m.end(), b)]
            else:  # what overlaps it may still be one
                todo += [(a, max(m.end() - 1, a)), (max(a, text.find(" ", m.start()) + 1), b)]


class Scanner:
    def __init__(self, base=BASE, notices=NOTICES, errors_per_chars: int = ERRORS_PER_CHARS):
        self.base = [(f" {phrase} ", label) for phrase, label in base]
        self.notices, self.seeds = [Notice(text, label, errors_per_chars) for text, label in notices], ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(self.notices):
            k = notice.errors
            edges = [len(notice.text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                at.setdefault(notice.text[a:b], []).append((number, a))
        for piece, where in at.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def places(self, text: str) -> tuple[int, int | None, int | None, set[str]]:
        """(number, smallest and largest first word, labels) of all base phrases; `text` has a space at both ends."""
        n, first, last, labels = 0, len(text), -1, set()
        for phrase, label in self.base:
            i = text.find(phrase)
            while i >= 0:
                n, first, last = n + 1, min(first, i), max(last, i)
                labels.add(label)
                i = text.find(phrase, i + 1)
        return (n, text.count(" ", 0, first), text.count(" ", 0, last), labels) if n else (0, None, None, labels)

    def matches(self, text: str) -> list[tuple[int, int, int, str, float]]:
        """(start, end, edits, label, similarity) of notices in a folded text, by start."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.seeds.iter(text):
            start = end + 1 - size
            for number, offset in where:
                notice = self.notices[number]
                a, b = max(0, start - offset - notice.errors - 1), start - offset + len(notice.text) + notice.errors + 1
                own = windows.setdefault(number, [])
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], a), max(own[-1][1], b)
                else:
                    own.append([a, b])
        found = []
        for number, spans in windows.items():
            notice = self.notices[number]
            width = len(notice.text) + 2 * notice.errors + 2
            for a, b in spans:
                got = set()
                for at in range(a, b, width):  # pieces of a long window overlap by a match and more
                    got |= set(notice.search(text, at, min(b, at + 2 * width, len(text))))
                taken: list[tuple[int, int]] = []
                for edits, start, end in sorted(got):
                    if all(end <= x or y <= start for x, y in taken[-64:]):
                        taken.append((start, end))
                        found.append((start, end, edits, notice.label, 1.0 - edits / len(notice.text)))
        return sorted(found)

    def __call__(self, raw: bytes | None):
        n_words, pieces = 0, []
        for part in parts(raw.translate(FOLD_WORDS) if raw else b""):
            if words := part.split():
                n_words += len(words)
                pieces.append(b" ".join(words))
        text = " " + b" ".join(pieces).decode("latin-1") + " "  # a character for each byte: places are bytes
        n, first, last, base = self.places(text)
        matches = self.matches(text)
        labels = base | {m[3] for m in matches}
        score = 1.0 if n else max((m[4] for m in matches), default=0.0)
        return n_words, n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, matches


def scan(docs: DataFrame, text_col: str = "text", carry=None, with_spans: bool = True) -> DataFrame:
    """Every row of `docs` as struct `rest`, with counts, labels, score and the spans (in bytes) in the folded text."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64()), ("label", pa.string())]))

    def work():
        scanner = Scanner()

        def each(texts):
            found = [scanner(x) for x in texts]
            out = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            if with_spans:
                # The folded text has a space in front here, so its own places are one less.
                out.append(pa.array([[{"start": m[0] - 1, "end": m[1] - 1, "edits": m[2], "label": m[3]} for m in f[7]] for f in found], span))
            return out

        return each

    ddl = "n_words long; n_base long; first_word long; last_word long; base_labels string; labels string; score double"
    if with_spans:
        ddl += "; spans array<struct<start:bigint,end:bigint,edits:bigint,label:string>>"
    return per_text(docs, text_col, carry, work, ddl)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), carry=["doc_id"], with_spans=False)
    return unpacked(found, ["doc_id"], "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
