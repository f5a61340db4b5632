import re
from re import _parser as sre_parser

from odd_rows import ODD

from shelfmark.llm import licenses


def brute(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns_against_brute_force(spark, odd, small):
    docs = odd.select("doc_id", "text").union(small.select("doc_id", "text"))
    texts = [t for _, t in ODD] + [r.text for r in small.collect()]
    got = licenses.scan(docs).select("n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(t)) for t in texts)


def test_rules_find_what_they_name():
    scanner = licenses.Scanner()
    assert 300 < len(scanner.rules) < 1000
    for text, label in [
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("released under the Apache License, Version 2.0.", "apache-2.0"),
        ("GPLv3", "gpl-3.0"), ("GNU General Public License, version 2", "gpl-2.0"), ("CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("MPL 2.0", "mpl-2.0"),
        ("https://creativecommons.org/licenses/by-sa/3.0", "cc-by-sa-3.0"), ("LGPL-2.1", "lgpl-2.1"), ("Unlicense", "unlicense"),
    ]:
        assert label in scanner.scan(text)[5].split(","), text
    for text in ("a permit of Apache origin", "the mit", "cc", "general public", ""):
        assert scanner.scan(text)[5] == ""


def test_containment_suppresses():
    scanner = licenses.Scanner()
    found = scanner.scan("licensed under the Apache License, Version 2.0")
    assert found[7] == 1 and found[5] == "apache,apache-2.0" and 0 < found[6] <= 1
    words = b"x apache license y"
    assert len(scanner.detect(words, set(words.split()))) == 1


def test_empty(none):
    assert licenses.scan(none).count() == 0


def test_a_rule_with_an_optional_last_word_matches_without_it():
    scanner = licenses.Scanner()
    for text in ("OpenRAIL", "BigScience OpenRAIL-M", "licensed under OpenRAIL"):
        assert "openrail" in scanner.scan(text)[5].split(","), text


def expansions(node):
    """Some texts that a parsed pattern matches: every branch and every class member that differs in words."""
    texts = [""]
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(a) for o, a in arg if str(o) == "LITERAL"] or ["x"]
        elif name == "BRANCH":
            more = [t for branch in arg[1] for t in expansions(branch)]
        elif name == "SUBPATTERN":
            more = expansions(arg[3])
        elif name == "MAX_REPEAT":
            more = ["", *expansions(arg[2])] if arg[0] == 0 else expansions(arg[2])
        else:
            assert name == "ASSERT_NOT"
            more = [""]
        texts = [a + b for a in texts for b in more][:400]
    return texts


def test_every_match_has_a_keyword_of_its_rule():
    scanner = licenses.Scanner()
    tried = 0
    for number, rule in enumerate(scanner.rules):
        for text in expansions(sre_parser.parse(rule.pattern.pattern.decode())):
            if not rule.pattern.fullmatch(text.encode()):
                continue
            tried += 1
            words = set(text.encode().split())
            assert words & set(rule.keywords), (rule.label, text)
            assert number in {n for k in scanner.by_keyword.keys() & words for n in scanner.by_keyword[k]}
    assert tried > 1500


def test_detections_equal_all_rules_without_the_prefilter(small):
    """Priority and containment by their definition, over all rules."""
    scanner = licenses.Scanner()
    texts = [r.text or "" for r in small.collect()] + [
        "licensed under the Apache License, Version 2.0 or the MIT license or GPL-2.0-or-later and End User License Agreement",
        "do what the fuck you want to public license, cc by 4.0 creative commons attribution 4.0 and cc by"]
    for text in texts:
        joined = b" ".join(text.encode().translate(licenses._WORD_BYTES).split())
        found = [(m.start(), m.end(), r.priority, n) for n, r in enumerate(scanner.rules) for m in r.pattern.finditer(joined)]

        def hidden(f):
            return any(g[2] <= f[2] and g[0] <= f[0] and f[1] <= g[1] and (g[1] - g[0], -g[2], -g[3]) > (f[1] - f[0], -f[2], -f[3])
                       for g in found)

        kept = {(a, b, n) for a, b, p, n in found if not hidden((a, b, p, n))}
        assert set(scanner.detect(joined, set(joined.split()))) == kept
