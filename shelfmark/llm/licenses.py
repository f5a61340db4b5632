"""License scan: ordered signature rules behind a keyword prefilter.

A text becomes its words (ASCII letters in lower case, digits, everything above ASCII), joined by single blanks. Each
rule is a pattern over that string with a keyword that every match contains; only rules whose keyword is among the
text's words run. Rules have a priority. A detection inside the interval of another one with the same or a higher
priority is suppressed, so that "apache license 2 0" wins over "apache license" and a full notice over the name in it.

Patterns are written as words with alternatives; the families below spell out, for each license, its names and
versions, and every name is looked for in the ways people state it: a tag, a notice, a grant, the bare name.
Null texts are empty. Repeated rows stay. Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.common import kept, map_columns, texts_of

#: Phrases whose every place counts, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

# Families: label, keyword, names (patterns over words), further keywords.
_NAMED = [
    ("apache-1.0", "apache", ["apache( software)? license( version)? 1 0"], []),
    ("apache-1.1", "apache", ["apache( software)? license( version)? 1 1"], []),
    ("apache-2.0", "apache", ["apache( software)? license( version)? 2( 0)?", "apache 2( 0)?( license)?", "asl 2 0"], ["asl"]),
    ("mit", "mit", ["mit license", "mit expat", "x11 mit", "mit x11"], ["expat"]),
    ("isc", "isc", ["isc license"], []),
    ("bsd-1-clause", "bsd", ["bsd 1 clause", "one clause bsd"], []),
    ("bsd-2-clause", "bsd", ["bsd 2 clause", "(2|two) clause bsd", "simplified bsd( license)?", "freebsd license"], ["freebsd"]),
    ("bsd-3-clause", "bsd", ["bsd 3 clause", "(3|three) clause bsd", "(new|modified|revised) bsd( license)?"], []),
    ("bsd-4-clause", "bsd", ["bsd 4 clause", "(4|four) clause bsd", "original bsd( license)?"], []),
    ("0bsd", "0bsd", ["0bsd"], []),
    ("gpl-1.0", "gpl", ["gpl ?v?1( 0)?"], ["gplv1", "gpl1"]),
    ("gpl-2.0", "gpl", ["gpl ?v?2( 0)?( only)?"], ["gplv2", "gpl2"]),
    ("gpl-2.0-or-later", "gpl", ["gpl ?v?2( 0)? or (any )?later"], ["gplv2", "gpl2"]),
    ("gpl-3.0", "gpl", ["gpl ?v?3( 0)?( only)?"], ["gplv3", "gpl3"]),
    ("gpl-3.0-or-later", "gpl", ["gpl ?v?3( 0)? or (any )?later"], ["gplv3", "gpl3"]),
    ("gpl-1.0", "gnu", ["gnu general public license( version| v)? ?1( 0)?"], []),
    ("gpl-2.0", "gnu", ["gnu general public license( version| v)? ?2( 0)?"], []),
    ("gpl-3.0", "gnu", ["gnu general public license( version| v)? ?3( 0)?"], []),
    ("lgpl-2.0", "lesser", ["gnu (lesser|library) general public license( version| v)? ?2( 0)?"], ["library"]),
    ("lgpl-2.1", "lesser", ["gnu lesser general public license( version| v)? ?2 1"], []),
    ("lgpl-3.0", "lesser", ["gnu lesser general public license( version| v)? ?3( 0)?"], []),
    ("lgpl-2.0", "lgpl", ["lgpl ?v?2( 0)?"], ["lgplv2", "lgpl2"]),
    ("lgpl-2.1", "lgpl", ["lgpl ?v?2 1"], ["lgplv2", "lgpl2"]),
    ("lgpl-3.0", "lgpl", ["lgpl ?v?3( 0)?"], ["lgplv3", "lgpl3"]),
    ("agpl-3.0", "affero", ["gnu affero general public license( version| v)? ?3?( 0)?"], []),
    ("agpl-3.0", "agpl", ["agpl ?v?3( 0)?"], ["agplv3", "agpl3"]),
    ("gfdl-1.3", "gnu", ["gnu free documentation license( version)?( 1 [123])?"], []),
    ("mpl-1.1", "mozilla", ["mozilla public license( version)? 1 1"], []),
    ("mpl-2.0", "mozilla", ["mozilla public license( version)? 2( 0)?"], []),
    ("mpl-2.0", "mpl", ["mpl ?2 0"], ["mpl2"]),
    ("epl-1.0", "eclipse", ["eclipse public license( version)? 1( 0)?"], []),
    ("epl-2.0", "eclipse", ["eclipse public license( version)? 2( 0)?"], []),
    ("cddl-1.0", "cddl", ["cddl ?1( 0)?"], ["cddl1"]),
    ("cddl-1.0", "distribution", ["common development and distribution license( version)?( 1 0)?"], []),
    ("cpl-1.0", "common", ["common public license( version)?( 1 0)?"], []),
    ("eupl-1.2", "eupl", ["eupl( v)?( 1 [12])?"], []),
    ("eupl-1.2", "european", ["european union public licence( v)?( 1 [12])?"], []),
    ("artistic-1.0", "artistic", ["artistic license( version)? 1( 0)?"], []),
    ("artistic-2.0", "artistic", ["artistic license( version)? 2( 0)?"], []),
    ("bsl-1.0", "boost", ["boost software license( version)?( 1 0)?"], []),
    ("zlib", "zlib", ["zlib( libpng)? license"], []),
    ("libpng", "libpng", ["libpng license"], []),
    ("unlicense", "unlicense", ["unlicense"], []),
    ("wtfpl", "wtfpl", ["wtfpl"], []),
    ("psf-2.0", "python", ["python software foundation license( version)?( 2)?"], []),
    ("python-2.0", "python", ["python license 2 0"], []),
    ("php-3.01", "php", ["php license( version)?( 3 0?1)?"], []),
    ("ruby", "ruby", ["ruby license"], []),
    ("perl", "perl", ["same terms as perl( itself)?"], []),
    ("ofl-1.1", "sil", ["sil open font license( version)?( 1 1)?"], []),
    ("ms-pl", "microsoft", ["microsoft public license"], []),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"], []),
    ("ncsa", "ncsa", ["(university of illinois )?ncsa( open source license)?"], []),
    ("openssl", "openssl", ["openssl license"], []),
    ("postgresql", "postgresql", ["postgresql licen[cs]e"], []),
    ("vim", "vim", ["vim license"], []),
    ("curl", "curl", ["curl license"], []),
    ("afl-3.0", "academic", ["academic free license( version)?( 3 0)?"], []),
    ("osl-3.0", "osl", ["osl ?3 0"], ["osl3"]),
    ("ecl-2.0", "educational", ["educational community license( version)?( 2 0)?"], []),
    ("upl-1.0", "universal", ["universal permissive license( version)?( 1 0)?"], []),
    ("mulanpsl-2.0", "mulan", ["mulan psl( v)?( ?2)?"], []),
    ("busl-1.1", "business", ["business source license( version)?( 1 1)?"], []),
    ("sspl-1.0", "sspl", ["sspl( 1 0)?"], []),
    ("elastic-2.0", "elastic", ["elastic license( version)?( 2 0)?"], []),
    ("odbl-1.0", "odbl", ["odbl( v)?( 1 0)?"], []),
    ("odbl-1.0", "database", ["open (data commons )?open database license", "open database license"], []),
    ("pddl-1.0", "pddl", ["pddl( 1 0)?"], []),
    ("openrail", "openrail", ["(bigscience )?openrail( m)?"], []),
    ("cc0-1.0", "cc0", ["cc0( 1 0)?"], []),
    ("cc0-1.0", "zero", ["creative commons zero", "cc zero"], []),
]
_CC = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
_CC_LONG = ["attribution", "attribution share ?alike", "attribution no ?deriv(s|atives)", "attribution non ?commercial",
            "attribution non ?commercial share ?alike", "attribution non ?commercial no ?deriv(s|atives)"]
_CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
# Ways to state a license: pattern around the name, priority (lower wins), weight of the evidence.
_FORMS = [
    ("spdx license identifier {}", 1, 0.99),
    ("(licensed|released|distributed|available|published|provided|covered) (under|by)( the)?( terms of)?( the)? {}", 2, 0.95),
    ("license[ds]? {}", 3, 0.8),
    ("{}", 4, 0.6),
]
# Sentences of license texts and notices: label, keyword, pattern, priority, weight.
_TEXTS = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.99),
    ("mit", "sublicense", "use copy modify merge publish distribute sublicense and or sell", 1, 0.95),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee", 1, 0.99),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 1, 0.95),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from", 2, 0.9),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software", 2, 0.95),
    ("apache-2.0", "apache", "www apache org licenses license 2 0", 1, 0.98),
    ("apache-2.0", "limitations", "see the license for the specific language governing permissions and limitations", 3, 0.8),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 2, 0.98),
    ("gpl-2.0-or-later", "gnu", "gnu general public license[a-z ]{0,60} version 2( of the license)? or (at your option )?any later", 1, 0.98),
    ("gpl-3.0-or-later", "gnu", "gnu general public license[a-z ]{0,60} version 3( of the license)? or (at your option )?any later", 1, 0.98),
    ("gpl", "gnu", "www gnu org licenses( gpl)?", 3, 0.7),
    ("lgpl", "lgpl", "lgpl", 5, 0.5),
    ("gpl", "gpl", "gpl", 5, 0.5),
    ("agpl", "agpl", "agpl", 5, 0.5),
    ("mpl-2.0", "mozilla", "subject to the terms of the mozilla public license v 2 0", 1, 0.98),
    ("mpl", "mozilla", "mozilla public license", 5, 0.6),
    ("epl", "eclipse", "eclipse public license", 5, 0.6),
    ("bsd", "bsd", "bsd( style)? licen[cs]e", 5, 0.6),
    ("apache", "apache", "apache license", 5, 0.6),
    ("gpl", "gnu", "gnu general public license", 5, 0.6),
    ("lgpl", "lesser", "gnu lesser general public license", 5, 0.6),
    ("cc-by", "cc", "cc by", 5, 0.6),
    ("creative-commons", "creativecommons", "creativecommons org licenses", 4, 0.7),
    ("creative-commons", "creative", "creative commons( licen[cs]e)?", 6, 0.4),
    ("all-rights-reserved", "reserved", "all rights reserved", 5, 0.5),
    ("proprietary", "proprietary", "(proprietary and confidential|confidential and proprietary)", 4, 0.7),
    ("proprietary", "unauthorized", "unauthorized (copying|reproduction|distribution)( of this file)?( via any medium)? is strictly prohibited", 3, 0.8),
    ("public-domain", "domain", "(released|dedicated|placed|is)( in| into| to)? the public domain", 4, 0.7),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1, 0.99),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 1, 0.95),
    ("bsl-1.0", "boost", "www boost org license 1 0", 1, 0.98),
    ("wtfpl", "want", "do what the fuck you want to public license", 1, 0.98),
    ("eula", "agreement", "end user licen[cs]e agreement", 4, 0.7),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    priority: int
    weight: float


def rules() -> list[Rule]:
    """All rules in order: statements of each name in each form, the Creative Commons grid, sentences of texts."""
    made: list[Rule] = []

    def add(label: str, keywords: list[str], pattern: str, priority: int, weight: float) -> None:
        source = f"(?<![^ ]){pattern}(?![^ ])".encode()
        made.append(Rule(label, tuple(k.encode() for k in keywords), re.compile(source), priority, weight))

    for label, keyword, names, more in _NAMED:
        name = "(" + "|".join(names) + ")"
        for form, priority, weight in _FORMS:
            add(label, [keyword, *more], form.format(name), priority, weight)
    for short, long in zip(_CC, _CC_LONG, strict=True):
        tag = f"cc-{short.replace(' ', '-')}"
        for version in _CC_VERSIONS:
            known = f"{tag}-{version.replace(' ', '.')}"
            add(known, ["cc"], f"cc {short} {version}", 3, 0.9)
            add(known, ["creative"], f"creative commons {long}( license)?( version)? {version}", 2, 0.95)
            add(known, ["creativecommons"], f"creativecommons org licenses {short} {version}", 1, 0.98)
        add(tag, ["cc"], f"cc {short}", 4, 0.6)
        add(tag, ["creative"], f"creative commons {long}", 4, 0.8)
    for label, keyword, pattern, priority, weight in _TEXTS:
        add(label, [keyword], pattern, priority, weight)
    return made


class Scanner:
    def __init__(self) -> None:
        self.rules = rules()
        self.by_keyword: dict[bytes, list[int]] = {}
        for number, rule in enumerate(self.rules):
            for keyword in rule.keywords:
                self.by_keyword.setdefault(keyword, []).append(number)
        self.base = [(f" {phrase} ".encode(), phrase.encode().split(), label) for phrase, label in BASE.items()]

    def detect(self, joined: bytes, words: set[bytes]) -> list[tuple[int, int, int]]:
        """Surviving detections ``(start, end, rule number)`` in the joined words, in order of place."""
        numbers = sorted({n for k in self.by_keyword.keys() & words for n in self.by_keyword[k]})
        found = [(m.start(), -m.end(), self.rules[n].priority, n) for n in numbers for m in self.rules[n].pattern.finditer(joined)]
        found.sort()
        # Going by start, then longest first, an interval lies inside an earlier one if that ends no earlier.
        furthest: dict[int, int] = {}
        kept_ones = []
        for start, minus_end, priority, n in found:
            if all(end < -minus_end for p, end in furthest.items() if p <= priority):
                kept_ones.append((start, -minus_end, n))
            furthest[priority] = max(furthest.get(priority, 0), -minus_end)
        return kept_ones

    def scan(self, text: str) -> tuple:
        """``n_words, n_base, first_word, last_word, base_labels, labels, score, n_rules``."""
        words = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
        joined = b" ".join(words)
        padded = b" " + joined + b" "
        places, base_labels = [], set()
        for needle, _, label in self.base:
            at = padded.find(needle)
            while at >= 0:
                places.append(at)
                base_labels.add(label)
                at = padded.find(needle, at + 1)
        first = padded.count(b" ", 0, min(places)) if places else None
        last = padded.count(b" ", 0, max(places)) if places else None
        found = self.detect(joined, set(words))
        doubt = 1.0
        for weight in {self.rules[n].label: self.rules[n].weight for _, _, n in sorted(
                found, key=lambda f: self.rules[f[2]].weight)}.values():
            doubt *= 1.0 - weight
        labels = base_labels | {self.rules[n].label for _, _, n in found}
        return (len(words), len(places), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)),
                round(1.0 - doubt, 6), len(found))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document.

    ``doc_id``; ``n_words``; ``n_base`` places of the base phrases, ``first_word`` and ``last_word`` of them (null
    without any); ``base_labels`` and ``labels`` (with those of the rules), sorted and comma-joined; ``score``, the
    chance that at least one label is right if rules err independently; ``n_rules`` detections left.
    """

    def work(texts: pa.Array) -> zip:
        scanner = kept("licenses", Scanner)
        return zip(*[scanner.scan(t) for t in texts_of(texts)], strict=True) if len(texts) else ([] for _ in range(8))

    return map_columns(
        docs.select("doc_id", "text"), work,
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "n_rules long", carry=["doc_id"])
