"""License scans by ordered signature rules.

A rule is a label, a priority, the keywords that gate it and a regular expression over the
normalised text: lower-case words joined by single blanks.  A gate holds only keywords that every match
of its expression contains; keywords parted by a slash stand for one another.  Keywords are found for a
whole block of texts by the hashes of their runs of ASCII letters and digits, as an expression also
matches next to quotes and dashes beyond ASCII, so that it runs only on texts
that hold all its keywords.  Where detections overlap, one that lies within another of higher
priority, or of the same priority and greater length, is suppressed.

Defined cases: a null or empty text has no words, no labels and score 0; labels are distinct and
sorted; the three fixed phrases are always reported, whatever suppresses them.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.tables import by_block, columns
from psephos.llm.text import WORD, Texts

# Phrases that are always looked for, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Families of licenses: label, gating word, name in running text, identifier.  Written by hand.
FAMILIES = r"""
apache-2.0      | apache     | apache(?: software)? licen[sc]e(?: version)? 2(?: 0)? | apache 2 0
apache-1.1      | apache     | apache(?: software)? licen[sc]e(?: version)? 1 1 | apache 1 1
apache          | apache     | apache(?: software)? licen[sc]e | apache
mit             | mit        | mit(?: expat)? licen[sc]e | mit
mit-0           | mit        | mit no attribution(?: licen[sc]e)? | mit 0
x11             | x11        | (?:mit )?x11 licen[sc]e | x11
bsd-2-clause    | bsd        | (?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)? | bsd 2 clause
bsd-3-clause    | bsd        | (?:new|revised|modified|3 clause|three clause) bsd(?: licen[sc]e)? | bsd 3 clause
bsd-4-clause    | bsd        | (?:original|4 clause|four clause) bsd(?: licen[sc]e)? | bsd 4 clause
0bsd            | bsd        | (?:zero clause|0 clause) bsd(?: licen[sc]e)? | 0bsd
bsd             | bsd        | bsd(?: style)? licen[sc]e | bsd
gpl-1.0         | gnu        | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:v|version )1 | gpl 1 0
gpl-2.0         | gnu        | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:v|version )2 | gpl 2 0
gpl-3.0         | gnu        | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:v|version )3 | gpl 3 0
gpl             | gnu        | gnu general public licen[sc]e | gpl
lgpl-2.1        | gnu        | gnu lesser general public licen[sc]e (?:v|version )2 1 | lgpl 2 1
lgpl-3.0        | gnu        | gnu lesser general public licen[sc]e (?:v|version )3 | lgpl 3 0
lgpl            | gnu        | gnu (?:lesser|library) general public licen[sc]e | lgpl
agpl-3.0        | affero     | (?:gnu )?affero general public licen[sc]e (?:v|version )3 | agpl 3 0
agpl            | affero     | (?:gnu )?affero general public licen[sc]e | agpl
fdl             | gnu        | gnu free documentation licen[sc]e | gfdl
mpl-1.1         | mozilla    | mozilla public licen[sc]e(?: v| version)? 1 1 | mpl 1 1
mpl-2.0         | mozilla    | mozilla public licen[sc]e(?: v| version)? 2 0 | mpl 2 0
mpl             | mozilla    | mozilla public licen[sc]e | mpl
epl-1.0         | eclipse    | eclipse public licen[sc]e(?: v| version)? 1 0 | epl 1 0
epl-2.0         | eclipse    | eclipse public licen[sc]e(?: v| version)? 2 0 | epl 2 0
edl             | eclipse    | eclipse distribution licen[sc]e | edl
cddl-1.0        | development | common development and distribution licen[sc]e(?: version)?(?: 1 0)? | cddl 1 0
cpl-1.0         | common     | common public licen[sc]e | cpl 1 0
eupl            | european   | european union public licen[sc]e | eupl
isc             | isc        | isc licen[sc]e | isc
zlib            | zlib       | zlib(?: libpng)? licen[sc]e | zlib
libpng          | libpng     | libpng licen[sc]e | libpng
boost-1.0       | boost      | boost software licen[sc]e | bsl 1 0
artistic-1.0    | artistic   | artistic licen[sc]e(?: version)? 1 0 | artistic 1 0
artistic-2.0    | artistic   | artistic licen[sc]e(?: version)? 2 0 | artistic 2 0
artistic        | artistic   | artistic licen[sc]e | artistic
python-2.0      | python/psf | (?:psf|python(?: software foundation)?) licen[sc]e | psf 2 0
ruby            | ruby       | ruby licen[sc]e | ruby
php-3.0         | php        | php licen[sc]e | php 3 0
perl            | perl       | same terms as perl(?: itself)? | perl
ofl-1.1         | sil        | sil open font licen[sc]e | ofl 1 1
unlicense       | unlicense  | (?:the )?unlicense | unlicense
wtfpl           | wtfpl      | wtfpl(?: licen[sc]e)? | wtfpl
postgresql      | postgresql | postgresql licen[sc]e | postgresql
openssl         | openssl    | openssl(?: and ssleay)? licen[sc]e | openssl
ncsa            | ncsa       | (?:university of illinois )?ncsa open source licen[sc]e | ncsa
upl-1.0         | permissive | universal permissive licen[sc]e | upl 1 0
ms-pl           | microsoft  | microsoft public licen[sc]e | ms pl
ms-rl           | microsoft  | microsoft reciprocal licen[sc]e | ms rl
odbl            | database   | open (?:data commons )?(?:open )?database licen[sc]e | odbl 1 0
odc-by          | commons    | open data commons attribution licen[sc]e | odc by 1 0
osl-3.0         | open       | open software licen[sc]e | osl 3 0
afl-3.0         | academic   | academic free licen[sc]e | afl 3 0
ecl-2.0         | educational | educational community licen[sc]e | ecl 2 0
cc0             | cc0        | cc0(?: 1 0)?(?: universal)? | cc0 1 0
cc-by           | cc         | cc by | cc by
cc-by           | attribution | creative commons attribution(?: \d \d)?(?: international| unported)? licen[sc]e | cc by 4 0
cc-by-sa        | cc         | cc by sa | cc by sa
cc-by-sa        | attribution | creative commons attribution share ?alike | cc by sa 4 0
cc-by-nc        | cc         | cc by nc | cc by nc
cc-by-nc        | attribution | creative commons attribution non ?commercial | cc by nc 4 0
cc-by-nd        | cc         | cc by nd | cc by nd
cc-by-nd        | attribution | creative commons attribution no ?derivatives? | cc by nd 4 0
cc-by-nc-sa     | cc         | cc by nc sa | cc by nc sa
cc-by-nc-sa     | attribution | creative commons attribution non ?commercial share ?alike | cc by nc sa 4 0
cc-by-nc-nd     | cc         | cc by nc nd | cc by nc nd
cc-by-nc-nd     | attribution | creative commons attribution non ?commercial no ?derivatives? | cc by nc nd 4 0
"""

# Rules of their own: label, priority, gating words, expression.  Written by hand.
CLAUSES = r"""
mit             | 80 | permission granted  | permission is hereby granted free of charge to any person obtaining a copy of this software
mit             | 60 | substantial         | the above copyright notice and this permission notice shall be included in all copies or substantial portions
isc             | 80 | permission fee      | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
bsd             | 70 | redistribution      | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause    | 75 | endorse             | neither the names? of .{1,120}? may be used to endorse or promote products
bsd-4-clause    | 75 | advertising         | all advertising materials mentioning features or use of this software
warranty        | 30 | warranty/warranties | (?:provided|distributed) .{0,80}?(?:as is )?without (?:any )?warrant(?:y|ies)
warranty        | 30 | warranties          | without warranties or conditions of any kind
zlib            | 70 | implied             | provided as is without any express or implied warranty
apache-2.0      | 75 | compliance          | you may not use this file except in compliance with the licen[sc]e
gpl             | 60 | redistribute        | you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
lgpl            | 65 | redistribute        | you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e
agpl            | 65 | redistribute        | you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
mpl-2.0         | 75 | mozilla             | subject to the terms of the mozilla public licen[sc]e v 2 0
unlicense       | 75 | unencumbered        | free and unencumbered software released into the public domain
public-domain   | 50 | domain              | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain   | 35 | domain              | (?:in the|is) public domain
cc0             | 70 | waived              | waived all copyright and related or neighboring rights
boost-1.0       | 70 | boost               | distributed under the boost software licen[sc]e
eupl            | 60 | eupl                | licensed under the eupl
wtfpl           | 70 | fuck                | do what the fuck you want to public licen[sc]e
beerware        | 70 | beer                | you can buy me a beer in return
commercial      | 50 | commercial          | (?:requires|under) a commercial licen[sc]e
non-commercial  | 50 | commercial          | (?:for )?non commercial (?:use|purposes) only
evaluation      | 50 | evaluation          | for evaluation purposes only
confidential    | 50 | confidential        | (?:proprietary and confidential|confidential and proprietary)
proprietary     | 45 | proprietary         | this (?:software|work|document) is proprietary
proprietary     | 55 | unauthorized        | unauthorized (?:copying|use|reproduction|distribution) .{0,80}?(?:strictly )?prohibited
reserved        | 40 | reserved            | all rights reserved
reserved        | 40 | vorbehalten         | alle rechte vorbehalten
reserved        | 40 | droits              | tous droits r[ée]serv[ée]s
reserved        | 40 | derechos            | todos los derechos reservados
copyright       | 20 | copyright           | copyright (?:c |© )?(?:19|20)\d\d
copyright       | 15 | copyrighted         | copyrighted (?:material|work)
eula            | 45 | user agreement      | end user licen[sc]e agreement
eula            | 45 | eula                | eula
tos             | 30 | terms               | (?:terms of (?:service|use) apply|subject to the terms of (?:service|use))
gpl             | 38 | general             | general public licen[sc]e
"""

# Links as their hosts write them: label, gating words, expression.  Written by hand.
LINKS = r"""
apache-2.0      | apache license      | apache org licenses license 2 0
apache-1.1      | apache license      | apache org licenses license 1 1
gpl             | gnu licenses        | gnu org licenses (?:old licenses )?gpl
gpl             | gnu copyleft        | gnu org copyleft gpl
gpl-1.0         | gnu licenses        | gnu org licenses (?:old licenses )?gpl 1 0
gpl-2.0         | gnu licenses        | gnu org licenses old licenses gpl 2 0
lgpl            | gnu licenses        | gnu org licenses (?:old licenses )?lgpl
lgpl            | gnu copyleft        | gnu org copyleft (?:lesser|lgpl)
lgpl-2.1        | gnu licenses        | gnu org licenses old licenses lgpl 2 1
agpl            | gnu licenses        | gnu org licenses agpl
fdl             | gnu licenses        | gnu org licenses (?:old licenses )?fdl(?: 1 \d)?
fdl             | gnu copyleft        | gnu org copyleft fdl
mpl-1.1         | mozilla mpl         | mozilla org (?:en us )?mpl (?:mpl )?1 1
mpl-2.0         | mozilla mpl         | mozilla org (?:en us )?mpl 2 0
mpl             | mozilla mpl         | mozilla org (?:en us )?mpl
epl-1.0         | eclipse legal       | eclipse org (?:org )?legal epl (?:v10|1 0)
epl-2.0         | eclipse legal       | eclipse org (?:org )?legal epl (?:v20|2 0)
edl             | eclipse edl         | eclipse org (?:org )?(?:legal|documents) edl
boost-1.0       | boost license       | boost org license 1 0
php-3.0         | php license         | php net license 3 0\d?
ofl-1.1         | sil ofl             | scripts sil org ofl
odbl            | opendatacommons     | opendatacommons org licenses odbl(?: 1 0)?
odc-by          | opendatacommons     | opendatacommons org licenses by(?: 1 0)?
cc0             | creativecommons zero | creativecommons org publicdomain zero(?: 1 0)?
cc-by           | creativecommons by  | creativecommons org licenses by(?: \d \d)?
cc-by-sa        | creativecommons sa  | creativecommons org licenses by sa(?: \d \d)?
cc-by-nc        | creativecommons nc  | creativecommons org licenses by nc(?: \d \d)?
cc-by-nd        | creativecommons nd  | creativecommons org licenses by nd(?: \d \d)?
cc-by-nc-sa     | creativecommons sa  | creativecommons org licenses by nc sa(?: \d \d)?
cc-by-nc-nd     | creativecommons nd  | creativecommons org licenses by nc nd(?: \d \d)?
"""


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]
    expression: re.Pattern[str]
    either: tuple[str, ...] = ()  # keywords of which one is enough

    def passes(self, present: set[str]) -> bool:
        """Whether the gate lets a text with these keywords through."""
        return present.issuperset(self.keywords) and (not self.either or not present.isdisjoint(self.either))


def _rule(label: str, priority: int, gate: str, expression: str) -> Rule:
    words = gate.split()
    either = tuple(word for group in words if "/" in group for word in group.split("/"))
    return Rule(label, priority, tuple(word for word in words if "/" not in word), re.compile(rf"\b(?:{expression})\b"), either)


def _split(table: str) -> list[list[str]]:
    """Rows of cells; only blanks around a bar part cells, as expressions hold bars too."""
    return [[cell.strip() for cell in re.split(r"\s+\|\s+", line.strip())] for line in table.splitlines() if line.strip()]


def all_rules() -> list[Rule]:
    """The clauses, the links of single hosts, and five forms of each family: identifier, notice, name, two links."""
    rules = []
    for label, priority, gate, expression in _split(CLAUSES):
        rules.append(_rule(label, int(priority), gate, expression))
    for label, gate, expression in _split(LINKS):
        rules.append(_rule(label, 60 + _version(label), gate, expression))
    for label, word, name, tag in _split(FAMILIES):
        version = _version(label)
        first = tag.split()[0]
        forms = [
            (90 + version, f"spdx {first}", rf"spdx licen[sc]e identifier {tag}(?: only| or later)?"),
            (70 + version, word, rf"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{name})"),
            (50 + version, word, rf"(?:{name})"),
            (60 + version, f"licenses {first}", rf"(?:opensource|spdx|gnu|apache|creativecommons|choosealicense) (?:org|com) licenses {tag}"),
            (60 + version, f"opensource license {first}", rf"opensource org license {tag}"),
        ]
        rules += [_rule(label, priority, gate, expression) for priority, gate, expression in forms]
    return rules


def _version(label: str) -> int:
    return 5 if re.search(r"\d", label) else 0


RULES = all_rules()
_GATES: dict[str, list[int]] = {}
for _number, _gated in enumerate(RULES):
    for _word in _gated.keywords + _gated.either:
        _GATES.setdefault(_word, []).append(_number)


def hashes_of(words: list[str]) -> np.ndarray:
    return Texts(pa.array(words)).words().hashes()


_KEYWORDS = sorted(_GATES)
_KEYS = hashes_of(_KEYWORDS)
_KEY_ORDER = np.argsort(_KEYS)
_ASCII = WORD.copy()
_ASCII[0x80:] = False


@dataclass(frozen=True)
class Detection:
    """Words ``start`` to ``end`` of a text match a rule."""

    start: int
    end: int
    priority: int
    label: str


def passing(present: set[str]) -> list[int]:
    """Numbers of the rules whose gate lets a text with these keywords through."""
    return sorted(number for number in {number for word in present for number in _GATES[word]} if RULES[number].passes(present))


def detections(words: list[str], present: set[str]) -> list[Detection]:
    """What the gated rules find in a text, before suppression."""
    text = " ".join(words)
    starts = np.cumsum([0, *(len(word) + 1 for word in words)]).tolist()
    found = []
    for number in passing(present):
        rule = RULES[number]
        for match in rule.expression.finditer(text):
            first, last = bisect_right(starts, match.start()) - 1, bisect_right(starts, match.end() - 1)
            found.append(Detection(first, last, rule.priority, rule.label))
    return found


def unsuppressed(found: list[Detection]) -> list[Detection]:
    """Without what lies within a detection of higher rank: more priority, then more words."""
    kept: list[Detection] = []
    for priority in sorted({one.priority for one in found}, reverse=True):
        above = sorted((one.start, one.end) for one in kept)
        reach = np.maximum.accumulate([end for _, end in above]).tolist() if above else []
        end_so_far = -1
        for one in sorted((x for x in set(found) if x.priority == priority), key=lambda d: (d.start, -d.end, d.label)):
            i = bisect_right(above, (one.start, float("inf"))) - 1
            if one.end <= end_so_far or i >= 0 and reach[i] >= one.end:
                continue
            end_so_far = one.end
            kept.append(one)
    return kept


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists the surviving detections as label:first word:end, the end exclusive.
    """
    schema = pa.schema([
        ("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.string()),
    ])
    phrases = [(label, hashes_of(phrase.split())) for phrase, label in PHRASES.items()]

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(block.column("text"), lower=True)
        words = texts.words(WORD[texts.data])
        hashes, owner, n = words.hashes(), words.text_of_each(), len(texts)
        n_base = np.zeros(n, np.int64)
        first, last = np.full(n, -1), np.full(n, -1)
        base: list[set[str]] = [set() for _ in range(n)]
        for label, parts in phrases:
            k = len(parts)
            at = np.flatnonzero(hashes[: max(len(hashes) - k + 1, 0)] == parts[0])
            for j in range(1, k):
                at = at[hashes[at + j] == parts[j]]
            at = at[owner[at + k - 1] == owner[at]] if len(at) else at
            for i, place in zip(owner[at].tolist(), (at - words.bounds[owner[at]]).tolist(), strict=True):
                n_base[i] += 1
                base[i].add(label)
                first[i] = place if first[i] < 0 else min(first[i], place)
                last[i] = max(last[i], place)
        plain = texts.words(_ASCII[texts.data]) if len(texts.data) and texts.data.max() > 0x7F else words
        hashes = hashes if plain is words else plain.hashes()
        slot = np.minimum(np.searchsorted(_KEYS[_KEY_ORDER], hashes), len(_KEYS) - 1)
        hits = np.flatnonzero(_KEYS[_KEY_ORDER][slot] == hashes)
        present: dict[int, set[str]] = {}
        for i, key in zip(plain.text_of_each()[hits].tolist(), _KEY_ORDER[slot[hits]].tolist(), strict=True):
            present.setdefault(i, set()).add(_KEYWORDS[key])
        labels, scores, spans = [",".join(sorted(x)) for x in base], np.where(n_base > 0, 0.4, 0.0), [""] * n
        for i, keywords in present.items():
            if not passing(keywords):
                continue
            low, high = words.bounds[i], words.bounds[i + 1]
            parts = [texts.data[s:e].tobytes().decode() for s, e in zip(words.starts[low:high].tolist(), words.ends[low:high].tolist(), strict=True)]
            kept = unsuppressed(detections(parts, keywords))
            labels[i] = ",".join(sorted(base[i] | {d.label for d in kept}))
            scores[i] = max([float(scores[i]), *(d.priority / 100 for d in kept)])
            spans[i] = ",".join(f"{d.label}:{d.start}:{d.end}" for d in sorted(kept, key=lambda d: (d.start, d.end, d.label)))
        none = first < 0
        return columns(
            schema, id=block.column("id"), n_words=words.counts, n_base=n_base, first_word=pa.array(first, mask=none),
            last_word=pa.array(last, mask=none), base_labels=[",".join(sorted(x)) for x in base], labels=labels,
            score=scores, spans=spans,
        )

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return by_block(
        rows, "text",
        "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans string",
        work,
    )
