import re
from collections import defaultdict

import pytest

from psephos.llm import licenses
from tests.llm.cases import LOWER, awkward_rows, ordered, prose, table

NOTICES = [
    (50, "Licensed under the Apache License, Version 2.0 (the 'License');\nyou may not use this file except in compliance with the License."),
    (51, "This work is licensed under the GNU General Public License, version 3."),
    (52, "// SPDX-License-Identifier: BSD-3-Clause\nAll rights reserved. All Rights Reserved!"),
    (53, "see CC-BY 4.0, cc by; Cc\n\tBY"),
    (54, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (55, "ccby general public licenses all right reserved ccc by"),
    (56, prose(3, 500) + " released into the public domain. " + "all rights reserved " * 300),
    (57, "Tous droits réservés"),
]


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(parts)] == parts]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_phrases_equal_plain_code(spark):
    rows = awkward_rows() + [(i, t, None, None, None) for i, t in NOTICES]
    found = licenses.scan(table(spark, rows)).collect()
    wanted = [(row[0], *brute(row[1])) for row in rows]
    assert ordered((r["id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == ordered(wanted)
    for row in found:
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert row["labels"] == ",".join(sorted(set(row["labels"].split(",")))) and 0 <= row["score"] <= 1
        assert (row["score"] > 0) == bool(row["labels"])


@pytest.mark.parametrize("doc, labels", [
    (50, "apache-2.0"), (51, "gpl,gpl-3.0"), (52, "bsd-3-clause,reserved"), (53, "cc-by"), (54, "mit"), (55, ""),
    (56, "public-domain,reserved"), (57, "reserved"),
])
def test_labels(spark, doc, labels):
    text = dict(NOTICES)[doc]
    row = licenses.scan(spark.createDataFrame([(doc, text)], "doc_id long, text string")).first()
    assert row["labels"] == labels


def test_prefilter_loses_nothing():
    """Every rule on every text, gated or not, finds the same."""
    for _, text in NOTICES:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        present = {w for w in words if w in licenses._GATES}
        gated = licenses.detections(words, present)
        joined = " ".join(words)
        every = [(r.label, m.span()) for r in licenses.RULES if set(r.keywords) <= set(words) for m in r.expression.finditer(joined)]
        assert len(gated) == len(every)


def test_suppression_equals_comparing_all_pairs():
    import random

    draw = random.Random(6)
    for _ in range(200):
        found = [licenses.Detection(s, s + draw.randint(1, 9), draw.choice([10, 20, 30]), draw.choice("abc")) for s in (draw.randint(0, 20) for _ in range(12))]
        kept = licenses.unsuppressed(found)
        rank = lambda d: (-d.priority, d.start - d.end, d.start, d.label)
        wanted = []
        for one in sorted(set(found), key=rank):
            if not any(o.start <= one.start and one.end <= o.end for o in wanted):
                wanted.append(one)
        assert sorted(kept, key=rank) == wanted


def test_rules_are_many_and_distinct(nothing):
    groups = defaultdict(int)
    for rule in licenses.RULES:
        groups[rule.label, rule.expression.pattern] += 1
    assert len(groups) > 250 and max(groups.values()) == 1
    assert licenses.scan(nothing).count() == 0


# A text for each alternative of a gate, for links as their hosts write them, and for words next to signs beyond ASCII.
ALTERNATIVES = [
    ("This End User License Agreement is made with you.", "eula"),
    ("Read the EULA", "eula"),
    ("Released under the PSF License", "python-2.0"),
    ("the psf licence", "python-2.0"),
    ("distributed on an as is basis without any warranties", "warranty"),
    ("provided without any warranty", "warranty"),
    ("subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("https://creativecommons.org/licenses/by/4.0/", "cc-by"),
    ("https://creativecommons.org/licenses/by-nc-sa/3.0/de/", "cc-by-nc-sa"),
    ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0"),
    ("http://www.apache.org/licenses/LICENSE-2.0.txt", "apache-2.0"),
    ("https://www.gnu.org/licenses/old-licenses/gpl-2.0.html", "gpl-2.0"),
    ("https://opensource.org/license/mit", "mit"),
    ("https://www.mozilla.org/en-US/MPL/2.0/", "mpl-2.0"),
    ("the \u201cApache License, Version 2.0\u201d \u2014 \u00abMIT License\u00bb", "apache-2.0,mit"),
]


def expansions(expression):
    """Texts that the expression matches, with each alternative and each part left out or in."""
    from re import _parser

    def written(nodes):
        texts = [""]
        for kind, value in nodes:
            name = str(kind)
            if name == "LITERAL":
                more = [chr(value)]
            elif name == "ANY":
                more = ["x"]
            elif name == "IN":
                more = [chr(v) if str(k) == "LITERAL" else "1" for k, v in value]
            elif name == "BRANCH":
                more = [text for branch in value[1] for text in written(branch)]
            elif name == "SUBPATTERN":
                more = written(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                more = [text * n for text in written(value[2]) for n in {value[0], min(value[1], value[0] + 1)}]
            else:
                assert name == "AT", name
                more = [""]
            texts = [a + b for a in texts for b in more]
        return texts

    return written(_parser.parse(expression.pattern))


def test_gates_are_in_every_match():
    for rule in licenses.RULES:
        for text in expansions(rule.expression):
            assert rule.expression.search(text), (rule, text)
            assert rule.passes(set(re.findall("[0-9a-z]+", text))), (rule, text)


@pytest.mark.parametrize("text, labels", ALTERNATIVES)
def test_every_alternative_is_found_as_without_gates(spark, text, labels):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    kept = licenses.unsuppressed([
        licenses.Detection(" ".join(words)[: m.start()].count(" "), " ".join(words)[: m.end()].count(" ") + 1, r.priority, r.label)
        for r in licenses.RULES for m in r.expression.finditer(" ".join(words))
    ])
    assert row["labels"] == labels
    assert row["spans"] == ",".join(f"{d.label}:{d.start}:{d.end}" for d in sorted(kept, key=lambda d: (d.start, d.end, d.label)))
    assert row["score"] == max(d.priority for d in kept) / 100
