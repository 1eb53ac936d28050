"""License scan by ordered signature rules.

A text is lower-cased (A-Z) and cut into words; rules are regular expressions
over the words joined by single spaces, so punctuation and line breaks do not
matter.  Hundreds of rules come from the table below: every license with its
names and versions, through the forms in which notices cite them; beside them
stand rules of SPDX short ids, versions joined to a name (GPLv2) and sentences
of license bodies.  A rule
carries a keyword of its own phrase that must be in the text before its regex
runs, a priority and a confidence; no other gate stands before the rules.

Overlaps: detections are taken by priority, then length, then start; one whose
words lie inside an already kept one is suppressed, so "apache license version
2 0" gives ``apache-2.0`` and not the bare name beside it.

Defined cases: a null or empty text has no words, no label, score 0; repeated
rows give repeated results; other columns are ignored; an empty table gives an
empty result.  Whole texts are scanned, one Arrow batch at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_rows

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label, keyword, names, versions.
FAMILIES = (
    ("agpl", "affero", ("gnu affero general public license", "affero general public license"), ("1.0", "3.0")),
    ("agpl", "agpl", ("agpl", "gnu agpl"), ("1.0", "3.0")),
    ("lgpl", "lesser", ("gnu lesser general public license", "lesser general public license"), ("2.1", "3.0")),
    ("lgpl", "library", ("gnu library general public license",), ("2.0",)),
    ("lgpl", "lgpl", ("lgpl", "gnu lgpl"), ("2.0", "2.1", "3.0")),
    ("gpl", "gnu", ("gnu general public license",), ("1.0", "2.0", "3.0")),
    ("gpl", "gpl", ("gpl", "gnu gpl"), ("1.0", "2.0", "3.0")),
    ("gfdl", "documentation", ("gnu free documentation license",), ("1.1", "1.2", "1.3")),
    ("apache", "apache", ("apache license", "apache software license"), ("1.0", "1.1", "2.0")),
    ("mit", "mit", ("mit license", "expat license", "mit expat license"), ()),
    ("bsd", "bsd", ("bsd license", "berkeley software distribution license"), ()),
    ("bsd-2-clause", "bsd", ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"), ()),
    ("bsd-3-clause", "bsd", ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"), ()),
    ("mpl", "mozilla", ("mozilla public license",), ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", ("mpl",), ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", ("eclipse public license",), ("1.0", "2.0")),
    ("eupl", "european", ("european union public licence", "european union public license"), ("1.0", "1.1", "1.2")),
    ("cddl", "distribution", ("common development and distribution license",), ("1.0", "1.1")),
    ("cpl", "common", ("common public license",), ("1.0",)),
    ("artistic", "artistic", ("artistic license", "perl artistic license"), ("1.0", "2.0")),
    ("bsl", "boost", ("boost software license",), ("1.0",)),
    ("isc", "isc", ("isc license",), ()),
    ("zlib", "zlib", ("zlib license", "zlib libpng license"), ()),
    ("unlicense", "unlicense", ("the unlicense",), ()),
    ("wtfpl", "wtfpl", ("wtfpl",), ("1", "2")),
    ("cc0", "cc0", ("cc0", "creative commons cc0"), ("1.0",)),
    ("cc0", "zero", ("creative commons zero",), ("1.0",)),
    ("cc-by", "cc", ("cc by",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "cc", ("cc by sa",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "cc", ("cc by nc",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "cc", ("cc by nd",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", "cc", ("cc by nc sa",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", "cc", ("cc by nc nd",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by", "attribution", ("creative commons attribution",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "sharealike", ("creative commons attribution sharealike",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "noncommercial", ("creative commons attribution noncommercial",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("odbl", "database", ("open database license",), ("1.0",)),
    ("ofl", "font", ("sil open font license",), ("1.0", "1.1")),
    ("python", "python", ("python software foundation license", "psf license"), ("2",)),
    ("php", "php", ("php license",), ("3.0", "3.01")),
    ("ms-pl", "microsoft", ("microsoft public license",), ()),
    ("postgresql", "postgresql", ("postgresql license",), ()),
    ("openssl", "openssl", ("openssl license",), ()),
    ("public-domain", "public", ("public domain",), ()),
    ("proprietary", "rights", ("all rights reserved",), ()),
)
# The forms of a notice, {n} a name, {v} a version's words:
# (form, priority, confidence); the last two columns say what the form needs.
VERSIONED = (
    (r"spdx license identifier {n} {v}", 90, 1.0),
    (r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{n} (?:version |v ?)?{v}", 80, 0.98),
    (r"{n} (?:as published by the free software foundation )?(?:either )?(?:version |v ?)?{v}(?: or later| only)?", 70, 0.95),
)
BARE = (
    (r"spdx license identifier {n}", 60, 0.9),
    (r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{n}", 50, 0.85),
    (r"(?:see|read|under) (?:the )?{n}", 40, 0.75),
    (r"{n}", 30, 0.6),
)
SHORT = {"mpl", "isc", "gpl"}  # names too short to count alone

# SPDX short ids; the label is the id in lower case, unless named.
SPDX = """
0BSD AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-1.0 APSL-2.0 Artistic-1.0
Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear
BSD-3-Clause-LBNL BSD-4-Clause BSD-4-Clause-UC BSL-1.0 BUSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-1.0
CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0
CC-BY-NC-SA-1.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0
CC-BY-ND-4.0 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B
CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.1 GFDL-1.2 GFDL-1.3
GPL-1.0 GPL-2.0 GPL-3.0 HPND ICU IJG IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.1 LGPL-3.0 Libpng LPL-1.02 LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1
MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NPOSL-3.0 ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0
PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SISSL Sleepycat SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim
W3C WTFPL X11 Xnet Zlib zlib-acknowledgement ZPL-2.0 ZPL-2.1
""".split()
# Ids that also name a program, a format or a body; in a sentence they need the word license after them.
PLAIN_WORDS = frozenset("curl FTL ICU IJG JSON Libpng NCSA OpenSSL PostgreSQL Ruby SISSL Sleepycat Vim W3C X11 Xnet Zlib".split())
SPDX_LABEL = {"Python-2.0": "python-2", "PSF-2.0": "python-2"}
# Exceptions and own ids that stand in SPDX expressions and are no license here.
SPDX_OTHER = r"(?:[^ ]+ )?(?:[^ ]+ )?exception(?: [0-9]+)*|linux syscall note|(?:documentref [^ ]+ )?licenseref(?: [^ ]+){1,3}?|none|noassertion"
# Names whose version is written into the word (GPLv2, LGPL3, Apache2).
JOINED = (
    ("agpl", "agpl", ("1.0", "3.0")), ("lgpl", "lgpl", ("2.0", "2.1", "3.0")), ("gpl", "gpl", ("1.0", "2.0", "3.0")),
    ("gfdl", "gfdl", ("1.1", "1.2", "1.3")), ("apache", "apache", ("1.0", "1.1", "2.0")), ("mpl", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "epl", ("1.0", "2.0")), ("eupl", "eupl", ("1.0", "1.1", "1.2")), ("cddl", "cddl", ("1.0", "1.1")),
)
# Characteristic sentences of license bodies: label, keyword, words, confidence.
BODIES = (
    ("mit", "granted", "permission is hereby granted free of charge", 0.7),
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                       "documentation files(?: the software)? to deal in the software without restriction", 0.97),
    ("ncsa", "granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                        "documentation files(?: the software)? to deal with the software without restriction", 0.95),
    ("bsl-1.0", "granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
                           "accompanying documentation", 0.97),
    ("ofl", "granted", "permission is hereby granted free of charge to any person obtaining a copy of the font software", 0.97),
    ("0bsd", "granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby "
                        "granted", 0.85),
    ("isc", "granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby "
                       "granted provided that", 0.95),
    ("postgresql", "granted", "permission to use copy modify and distribute this software and its documentation for any purpose without fee "
                              "and without a written agreement is hereby granted", 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?", 0.85),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                                        "following disclaimer in the documentation and or other materials provided with the distribution this "
                                        "software is provided", 0.93),
    ("bsd-3-clause", "endorse", "neither the names? of (?:[^ ]+ ){1,20}?may be used to endorse or promote products derived from this software",
     0.9),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display", 0.93),
    ("apache-2.0", "reproduction", "terms and conditions for use reproduction and distribution", 0.85),
    ("apache-2.0", "required", "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
                               "on an as is basis", 0.9),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
     0.6),
    ("gpl-2.0", "freedom", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu "
                           "general public license is", 0.95),
    ("lgpl", "freedom", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu "
                        "general public licenses are", 0.9),
    ("gpl-3.0", "freedom", "the licenses for most software and other practical works are designed to take away your freedom to share and change "
                           "the works by contrast the gnu general public license is", 0.95),
    ("agpl-3.0", "freedom", "the licenses for most software and other practical works are designed to take away your freedom to share and change "
                            "the works by contrast our general public licenses are", 0.95),
    ("zlib", "liable", "this software is provided as is without any express or implied warranty in no event will the authors? be held liable for "
                       "any damages arising from the use of this software", 0.93),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 0.97),
    ("wtfpl", "fuck", "(?:you just )?do what the fuck you want to(?: public license)?", 0.9),
    ("cc0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain", 0.95),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 0.85),
    ("python", "python", "this license agreement is between the python software foundation", 0.95),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    regex: re.Pattern
    priority: int
    score: float


def _hand_written() -> list[tuple[str, str, str, int, float]]:
    """Rules of SPDX short ids, joined versions and license bodies."""
    out = []
    ids = {i: re.sub("[^a-z0-9]+", " ", i.lower()) for i in SPDX}
    known = "|".join([*sorted(ids.values(), key=len, reverse=True), SPDX_OTHER])
    # the ids of an expression ("MIT OR GPL-2.0-only WITH ...") are labelled one by one: a rule's group is its place
    before = rf"spdx license identifier (?:(?:{known})(?: only| or later)? (?:or|and|with) )*"
    for i, words in ids.items():
        label = SPDX_LABEL.get(i, i.lower())
        out.append((label, "spdx", rf"{before}({words}(?: only| or later)?)", 95, 1.0))
        word = f"{words} licen[cs]e" if i in PLAIN_WORDS else words
        out.append((label, max(words.split(), key=len),
                    rf"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{word}", 75, 0.9))
    for label, name, versions in JOINED:
        for v in versions:
            major, _, minor = v.partition(".")
            out.append((f"{label}-{v}", name, rf"(?:gnu )?{name}v?{major}" + (rf"[ ]{minor}" if minor != "0" else "(?:[ ]0)?"), 70, 0.9))
    return out + [(label, keyword, words, 85, score) for label, keyword, words, score in BODIES]


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    out = []
    for label, keyword, names, versions in FAMILIES:
        for name in names:
            word = keyword if keyword in name else max(set(name.split()) - {"license"}, key=lambda w: (len(w), w))
            for v in versions:
                major, _, minor = v.partition(".")
                words = f"(?:{major}[ ]{minor}|{major})" if minor in ("", "0") and minor else f"{major}[ ]{minor}" if minor else major
                for form, priority, score in VERSIONED:
                    out.append((f"{label}-{v}", word, form.format(n=name, v=words), priority, score))
            for form, priority, score in BARE:
                if form != "{n}" or name not in SHORT:
                    out.append((label, word, form.format(n=name), priority, score))
    out += _hand_written()
    made = [Rule(lab, key.encode(), re.compile(rf"(?<= ){pattern}(?= )".encode()), pr, sc)
            for lab, key, pattern, pr, sc in dict.fromkeys(out)]
    return tuple(sorted(made, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def _by_keyword() -> dict[bytes, list[Rule]]:
    out: dict[bytes, list[Rule]] = {}
    for rule in rules():
        out.setdefault(rule.keyword, []).append(rule)
    return out


#: Every byte that is no part of a word becomes a space.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_joined(text: str) -> tuple[bytes, int]:
    """The words with one space before, between and after them, and their number."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTES).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" " if words else b"", len(words)


def base_places(line: bytes) -> list[tuple[int, str]]:
    """(byte offset, label) of every place where a base phrase stands, overlaps included."""
    found = []
    for phrase, label in BASE.items():
        needle, at = f" {phrase} ".encode(), -1
        while (at := line.find(needle, at + 1)) >= 0:
            found.append((at, label))
    return sorted(found)


def detect(line: bytes) -> list[tuple[int, int, str, float]]:
    """Kept detections (byte start, byte end, label, score) after suppression."""
    hits = []
    for keyword, own in _by_keyword().items():
        if keyword in line:
            for rule in own:
                hits += [(rule.priority, *m.span(m.lastindex or 0), rule.label, rule.score) for m in rule.regex.finditer(line)]
    hits.sort(key=lambda h: (-h[0], h[1] - h[2], h[1], h[3]))
    return sorted(_uncovered([h[1:] for h in hits]))


def _uncovered(hits: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The hits, in the order given, that lie inside no hit taken before.

    A binary indexed tree over the starts holds the furthest end taken so far
    at or before each, so a text of many hits costs n log n."""
    place = {start: i for i, start in enumerate(sorted({h[0] for h in hits}), 1)}
    furthest = [-1] * (len(place) + 1)
    kept = []
    for hit in hits:
        start, end = hit[:2]
        at, reach = place[start], -1
        while at:
            reach, at = max(reach, furthest[at]), at & (at - 1)
        if reach < end:
            kept.append(hit)
            at = place[start]
            while at < len(furthest):
                furthest[at] = max(furthest[at], end)
                at += at & -at
    return kept


def _scan(cols: dict[str, list], id_col: str, text_col: str) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in (id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
    for key, text in zip(cols[id_col], cols[text_col]):
        line, n = words_joined(text or "")
        places = base_places(line)
        found = detect(line)
        base = sorted({label for _, label in places})
        out[id_col].append(key)
        out["n_words"].append(n)
        out["n_base"].append(len(places))
        out["first_word"].append(line.count(b" ", 0, places[0][0]) if places else None)
        out["last_word"].append(line.count(b" ", 0, places[-1][0]) if places else None)
        out["base_labels"].append(",".join(base))
        out["labels"].append(",".join(sorted({*base, *(label for _, _, label, _ in found)})))
        out["score"].append(max([s for _, _, _, s in found] + [0.6] * bool(base), default=0.0))
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base places, labels and the best rule's confidence."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, "
              "base_labels string, labels string, score double")
    return map_rows(docs.select(id_col, text_col), lambda c: _scan(c, id_col, text_col), schema)
