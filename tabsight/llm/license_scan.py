"""License scan: ordered signature rules behind a keyword prefilter.

A few hundred regular expressions (license families crossed with the forms in which a license is
named, plus signature sentences of the license texts) run on the ASCII-lower-cased text. A blank of
a rule stands for any white space, line breaks and the comment signs that lines start with among it.
One pass of a keyword automaton over the text, each such gap made one blank, decides which rules can
match at all; a text without any keyword runs none. Detections are then resolved by priority: one that lies inside the interval of another of
higher priority, or of a longer one of the same priority, is suppressed.

Beside the rules, *phrases* are looked up on words (runs of ``0-9``, ``a-z`` and non-ASCII
characters): every place where a phrase's words stand consecutively counts.

Work is per row, without shuffle. Defined results: a null text is scanned as an empty one, which
has no words, detections or labels and scores 0. Repeated rows are scanned alike.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, functions as F

from tabsight.llm.common import ship

# Fixed values: (label, name, keywords of which one must occur, versions that get labels of their own).
FAMILIES = (
    ("gpl", r"gnu (?:general public|gpl) licen[sc]e|gnu gpl|\bgpl", ("gnu", "gpl"), ("1", "2", "3")),
    ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e|\blgpl", ("lesser", "library general", "lgpl"), ("2", "2.1", "3")),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e|\bagpl", ("affero", "agpl"), ("1", "3")),
    ("gfdl", r"gnu free documentation licen[sc]e|\bgfdl", ("documentation licen", "gfdl"), ("1.1", "1.2", "1.3")),
    ("apache", r"apache (?:software )?licen[sc]e", ("apache",), ("1.0", "1.1", "2.0")),
    ("mit", r"\bmit licen[sc]e|massachusetts institute of technology licen[sc]e|\bexpat licen[sc]e", ("mit licen", "massachusetts", "expat licen"), ()),
    ("bsd", r"\bbsd(?: [234]-clause)? licen[sc]e|berkeley software distribution", ("bsd", "berkeley"), ()),
    ("bsd-2-clause", r"(?:bsd 2-clause|2-clause bsd|simplified bsd|freebsd licen[sc]e)", ("bsd",), ()),
    ("bsd-3-clause", r"(?:bsd 3-clause|3-clause bsd|new bsd|modified bsd)", ("bsd",), ()),
    ("mpl", r"mozilla public licen[sc]e|\bmpl", ("mozilla", "mpl"), ("1.0", "1.1", "2.0")),
    ("epl", r"eclipse public licen[sc]e|\bepl", ("eclipse", "epl"), ("1.0", "2.0")),
    ("cddl", r"common development and distribution licen[sc]e|\bcddl", ("common development", "cddl"), ("1.0", "1.1")),
    ("cpl", r"common public licen[sc]e", ("common public",), ("1.0",)),
    ("eupl", r"european union public licen[sc]e|\beupl", ("european union public", "eupl"), ("1.1", "1.2")),
    ("isc", r"\bisc licen[sc]e|internet systems consortium licen[sc]e", ("isc licen", "internet systems"), ()),
    ("zlib", r"\bzlib(?:/libpng)? licen[sc]e", ("zlib",), ()),
    ("boost", r"boost software licen[sc]e", ("boost software",), ("1.0",)),
    ("artistic", r"artistic licen[sc]e", ("artistic",), ("1.0", "2.0")),
    ("unlicense", r"\bthe unlicen[sc]e", ("the unlicen",), ()),
    ("wtfpl", r"do what the f\S+ you want to public licen[sc]e|\bwtfpl", ("do what the", "wtfpl"), ()),
    ("ofl", r"sil open font licen[sc]e|\bofl", ("open font", "ofl"), ("1.0", "1.1")),
    ("postgresql", r"postgresql licen[sc]e", ("postgresql",), ()),
    ("python", r"python software foundation licen[sc]e|\bpsf licen[sc]e", ("python software", "psf licen"), ("2",)),
    ("ruby", r"\bruby licen[sc]e", ("ruby licen",), ()),
    ("php", r"\bphp licen[sc]e", ("php licen",), ("3.0", "3.01")),
    ("ms-pl", r"microsoft public licen[sc]e|\bms-pl", ("microsoft public", "ms-pl"), ()),
    ("ms-rl", r"microsoft reciprocal licen[sc]e|\bms-rl", ("microsoft reciprocal", "ms-rl"), ()),
    ("odbl", r"open database licen[sc]e|\bodbl", ("open database", "odbl"), ("1.0",)),
    ("pddl", r"public domain dedication and licen[sc]e|\bpddl", ("public domain dedication", "pddl"), ()),
    ("cc0", r"creative commons zero|\bcc0", ("commons zero", "cc0"), ("1.0",)),
    ("cc-by", r"\bcc[- ]by|creative commons attribution", ("cc by", "cc-by", "commons attribution"), ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", r"\bcc[- ]by[- ]sa|creative commons attribution[- ]share-?\s?alike", ("by-sa", "by sa", "alike"), ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", r"\bcc[- ]by[- ]nc|creative commons attribution[- ]non-?commercial", ("by-nc", "by nc", "commercial"), ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", r"\bcc[- ]by[- ]nd|creative commons attribution[- ]no-?\s?deriv\w+", ("by-nd", "by nd", "deriv"), ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", r"\bcc[- ]by[- ]nc[- ]sa", ("nc-sa", "nc sa"), ("2.0", "3.0", "4.0")),
    ("cc-by-nc-nd", r"\bcc[- ]by[- ]nc[- ]nd", ("nc-nd", "nc nd"), ("2.0", "3.0", "4.0")),
    ("openrail", r"\b(?:creativeml )?open rail(?:-m)?\b|\bopenrail", ("open rail", "openrail"), ()),
)
# Fixed values: (form, before the name, after the name, priority, weight).
FORMS = (
    ("tag", r"spdx-licen[sc]e-identifier:\s*(?:", r")[\w.+-]*", 6, 1.0),
    ("notice", r"licen[sc]ed (?:to you )?under (?:the )?(?:terms of (?:the )?)?(?:", r")(?!\w)", 5, 0.95),
    ("grant", r"(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:", r")(?!\w)", 5, 0.9),
    ("terms", r"(?:subject to|in accordance with|pursuant to) (?:the )?(?:terms of (?:the )?)?(?:", r")(?!\w)", 5, 0.85),
    ("heading", r"(?m)^\s*(?:licen[sc]e:\s*)(?:the )?(?:", r")(?!\w)", 4, 0.9),
    ("name", r"(?:", r")(?!\w)", 2, 0.6),
)
# Sentences of license texts and notices: (label, pattern, keyword or keywords, priority, weight).
SENTENCES = (
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", "hereby granted", 7, 1.0),
    ("isc", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", "permission to use", 7, 0.95),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification", "redistribution and use", 7, 1.0),
    ("bsd-3-clause", r"neither the name of (?s:.{1,80}?) nor the names of its contributors", "nor the names", 7, 0.95),
    ("gpl", r"this program is free software[;:,] you can redistribute it", "free software", 7, 0.95),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e", "have received a copy", 7, 0.95),
    ("lgpl", r"you should have received a copy of the gnu lesser general public licen[sc]e", "have received a copy", 7, 0.95),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[sc]e", "have received a copy", 7, 0.95),
    ("apache", r"you may not use this file except in compliance with the licen[sc]e", "except in compliance", 7, 0.95),
    ("mpl", r"this source code form is subject to the terms of the mozilla public licen[sc]e", "source code form", 7, 1.0),
    ("boost", r"permission is hereby granted, free of charge, to any person or organization", "hereby granted", 7, 0.95),
    ("zlib", r"this software is provided 'as-is', without any express or implied warranty", "as-is", 7, 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 7, 1.0),
    ("public-domain", r"(?:dedicated to|released into|placed in|in) the public domain", "public domain", 3, 0.7),
    ("cc-by", r"creativecommons\.org/licenses/by/\d\.\d", "creativecommons.org", 7, 1.0),
    ("cc-by-sa", r"creativecommons\.org/licenses/by-sa/\d\.\d", "creativecommons.org", 7, 1.0),
    ("cc-by-nc", r"creativecommons\.org/licenses/by-nc/\d\.\d", "creativecommons.org", 7, 1.0),
    ("cc-by-nd", r"creativecommons\.org/licenses/by-nd/\d\.\d", "creativecommons.org", 7, 1.0),
    ("cc-by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa/\d\.\d", "creativecommons.org", 7, 1.0),
    ("cc-by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd/\d\.\d", "creativecommons.org", 7, 1.0),
    ("cc0", r"creativecommons\.org/publicdomain/zero/1\.0", "creativecommons.org", 7, 1.0),
    ("apache-2.0", r"apache\.org/licenses/license-2\.0", "apache.org", 7, 1.0),
    ("gpl", r"gnu\.org/licenses/(?:old-licenses/)?gpl", "gnu.org", 7, 0.95),
    ("lgpl", r"gnu\.org/licenses/(?:old-licenses/)?lgpl", "gnu.org", 7, 0.95),
    ("agpl", r"gnu\.org/licenses/agpl", "gnu.org", 7, 0.95),
    ("mit", r"opensource\.org/licenses?/mit\b", "opensource.org", 7, 1.0),
    ("bsd", r"opensource\.org/licenses?/bsd", "opensource.org", 7, 0.95),
    ("proprietary", r"all rights reserved", "all rights", 1, 0.5),
    ("proprietary", r"proprietary and confidential", "proprietary", 3, 0.8),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)", "unauthori", 3, 0.7),
    ("proprietary", r"may not be (?:copied|reproduced|distributed|published)", "may not be", 1, 0.5),
    ("copyright", r"(?:©|\(c\)|copyright) ?(?:©|\(c\))? ?(?:19|20)\d\d", ("copyright", "©", "(c)"), 1, 0.4),
)
# Phrases counted on words, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
PHRASE_WEIGHT = 0.6


# A longer run of white space is read as one line break, or blank, so that no rule scans it again from every place.
_LONG_RUN = re.compile(r"\s{17,}")


def fold_runs(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text with each long run of white space as one character, and per run its place there, its start and end
    in the text, and where its first line after a break begins."""
    out, runs, upto, length = [], [], 0, 0
    for m in _LONG_RUN.finditer(text):
        out.append(text[upto:m.start()])
        length += m.start() - upto
        line = text.find("\n", m.start(), m.end())
        out.append(" " if line < 0 else "\n")
        runs.append((length, m.start(), m.end(), line + 1))
        length, upto = length + 1, m.end()
    return ("".join([*out, text[upto:]]), runs) if runs else (text, runs)


def unfolded(start: int, end: int, runs: list[tuple[int, int, int, int]], at_line: bool) -> tuple[int, int]:
    """The interval in the text for one in the folded text. ``at_line``: the match takes the white space before it, from
    the first line of the run on."""
    def back(place: int) -> int:
        i = bisect_left(runs, (place,)) - 1  # the last run before the place
        return place if i < 0 else place - runs[i][0] - 1 + runs[i][2]

    i = bisect_left(runs, (start,)) - 1
    first = runs[i][3] if at_line and i >= 0 and runs[i][0] + 1 == start and runs[i][3] else back(start)
    return first, back(end)


# Comment signs at the start of a line, and a gap between two words of a rule.
_SIGNS = r"\n[^\S\n]*(?:[*#/;%!>|]+|--+)"
_GAP = rf"(?>(?:\s*{_SIGNS})+\s*|\s+)"


def _with_gaps(pattern: str) -> str:
    """The pattern with a gap for every blank."""
    for blank, gap in (("[- ]", f"(?:-|{_GAP})"), (r"[\s,(-]*", f"(?>{_GAP}|[,(-])*+"), (r"[\s,(]*", f"(?>{_GAP}|[,(])*+"),
                       (r"\s?", f"{_GAP}?"), (" ", _GAP)):
        pattern = pattern.replace(blank, gap)
    return pattern


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    weight: float


def build_rules() -> list[Rule]:
    """Every family in every form, again with each of its versions, and the sentences."""
    rules = []
    for label, name, keywords, versions in FAMILIES:
        for form, before, after, priority, weight in FORMS:
            rules.append(Rule(f"{label}:{form}", label, _with_gaps(before + name + after), keywords, priority, weight))
            for v in versions if form in ("tag", "notice", "grant", "name") else ():
                number = re.escape(v) + (r"(?:\.0)?" if "." not in v else "") + r"(?![\w.]*\d)"
                tail = rf")[\s,(-]*(?:licen[sc]e[\s,(]*)?(?:version |ver\.? ?|v\.? ?)?{number}"
                rules.append(Rule(f"{label}-{v}:{form}", f"{label}-{v}", _with_gaps(before + name + tail), keywords,
                                  priority + 1, min(1.0, weight + 0.04)))
    for i, (label, pattern, keyword, priority, weight) in enumerate(SENTENCES):
        keywords = (keyword,) if isinstance(keyword, str) else keyword
        rules.append(Rule(f"{label}:sentence{i}", label, _with_gaps(pattern), keywords, priority, weight))
    return rules


_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32
                    for b in range(256))
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


class Scanner:
    def __init__(self, rules: list[Rule]) -> None:
        self.rules = [(r, re.compile(r.pattern)) for r in rules]
        words: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for k in r.keywords:
                words.setdefault(k, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, which in words.items():
            self.automaton.add_word(k, (k, tuple(which)))
        self.automaton.make_automaton()
        self.signs = re.compile(_SIGNS)
        self.phrases = [(re.compile(b"(?=" + re.escape(f" {p} ".encode()) + b")"), label) for p, label in PHRASES]

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        lower = text.translate(_LOWER) if not text.isascii() else text.lower()
        able: set[int] = set()
        for _, (_, which) in self.automaton.iter(" ".join(self.signs.sub("\n", lower).split())):
            able.update(which)
        folded, runs = fold_runs(lower) if able else (lower, [])
        found = [(m.start(), m.end(), rule) for i in sorted(able) for rule, pattern in (self.rules[i],)
                 for m in pattern.finditer(folded) if m.end() > m.start()]
        if runs:
            found = [(*unfolded(a, z, runs, rule.pattern.startswith("(?m)^")), rule) for a, z, rule in found]
        return _resolve(found)

    def scan(self, text: str | None) -> dict:
        raw = (text or "").encode().translate(_WORD_BYTES)
        words = raw.split()
        places: list[int] = []
        base = set()
        if b"license" in raw or b"cc" in raw:
            line = b" " + b" ".join(words) + b" "
            for pattern, label in self.phrases:
                at = [m.start() for m in pattern.finditer(line)]
                if at:
                    base.add(label)
                    blanks, upto = 0, 0
                    for a in at:  # the words before a place are the blanks before it
                        blanks, upto = blanks + line.count(b" ", upto, a), a
                        places.append(blanks)
        kept = self.detections(text) if text else []
        labels = base | {r.label for _, _, r in kept}
        doubt = 1.0
        for weight in [r.weight for _, _, r in kept] or [PHRASE_WEIGHT] * bool(base):
            doubt = min(doubt, 1 - weight)
        return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None),
                "last_word": max(places, default=None), "base_labels": sorted(base), "labels": sorted(labels),
                "score": 1 - doubt,
                "detections": [{"start": s, "end": e, "label": r.label, "rule": r.name, "weight": r.weight} for s, e, r in kept]}


def _resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Without those inside the interval of a kept one of higher priority or, within a priority,
    of a longer or earlier-listed one; sorted by place."""
    kept: list[tuple[int, int, Rule]] = []
    for level in sorted({r.priority for _, _, r in found}, reverse=True):
        starts, reach = [], []  # of the kept ones: starts, and the furthest end up to each
        for s, e, _ in sorted(kept, key=lambda d: d[0]):
            starts.append(s)
            reach.append(max(e, reach[-1] if reach else e))
        furthest = -1
        for s, e, r in sorted((d for d in found if d[2].priority == level), key=lambda d: (d[0], -d[1])):
            i = bisect_right(starts, s) - 1
            if e > furthest and not (i >= 0 and reach[i] >= e):
                kept.append((s, e, r))
            furthest = max(furthest, e)
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].name))


_SCANNER: list[Scanner] = []


def scan_column(spark, text: str = "text") -> Column:
    """The whole scan of a text as a struct column."""
    ship(spark)

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
                  "labels array<string>, score double, detections array<struct<start: long, end: long, label: string, "
                  "rule: string, weight: double>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not _SCANNER:
            _SCANNER.append(Scanner(build_rules()))
        for texts in batches:
            found = pd.DataFrame([_SCANNER[0].scan(t) for t in texts],
                                 columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
            for c in ("first_word", "last_word"):
                found[c] = found[c].astype("Int64")
            yield found

    return scan(text)
