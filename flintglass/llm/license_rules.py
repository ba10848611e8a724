"""License scan by ordered signature rules.

Several hundred regular expressions run over the ASCII-lower-cased text: statements that name a license (families of
licenses x forms of statement) and signatures of the license texts themselves (grants, conditions, disclaimers). An
Aho-Corasick automaton finds the keywords first, and only rules whose keywords occur are tried. Overlapping detections
are resolved by rank (longer forms first) and by containment: an interval inside one of a better or equal rank is dropped.

Defined results: null text = empty text (counts 0, labels empty, score 0); one row for each input row; equal intervals
keep the rule that stands first.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import _ALNUM, lower_ascii, per_row

# Label, then the names (regular expressions over lower-case text) under which the license is stated.
FAMILIES = """
mit | mit | mit/x11 | x11 | expat
apache | apache(?:,)? (?:license(?:,)? )?(?:version )?v?2(?:\\.0)? | apache(?: software)? | apache[- ]2\\.0
gpl | gnu general public | gnu gpl ?v?[123](?:\\.0)?(?: or later)? | gpl ?v?[23](?:\\.0)?\\+? | general public
lgpl | gnu (?:lesser|library) general public | lgpl[- ]?v?[23](?:\\.[01])?\\+?
agpl | gnu affero general public | agpl[- ]?v?3(?:\\.0)?\\+?
bsd | bsd | bsd[- ][0234][- ]clause | (?:new|modified|simplified|revised) bsd
mpl | mozilla public | mpl[- ]?v?[12]\\.[01]
epl | eclipse public | epl[- ]?v?[12]\\.0
cc0 | cc0(?:[- ]1\\.0)? | creative commons zero
cc-by-nc | cc[- ]by[- ]nc(?:[- ](?:sa|nd))?(?:[- ][1-4]\\.0)? | creative commons attribution[- ]noncommercial
cc-by-sa | cc[- ]by[- ]sa(?:[- ][1-4]\\.0)? | creative commons attribution[- ]sharealike
cc-by | cc[- ]by(?:[- ][1-4]\\.0)? | creative commons attribution
isc | isc
zlib | zlib(?:/libpng)?
boost | boost software | bsl[- ]1\\.0
unlicense | unlicense
wtfpl | wtfpl | do what the fuck you want to public
artistic | artistic(?: license)?(?:[- ][12]\\.0)?
cddl | common development and distribution | cddl[- ]1\\.[01]
eupl | european union public | eupl[- ]?v?1\\.[0-2]
ofl | sil open font | ofl[- ]1\\.1
psf | python software foundation | psf(?:[- ]2\\.0)?
ms-pl | microsoft public | ms-pl
proprietary | proprietary | commercial
"""
# Forms of a statement, best rank first; {n} is a name.
FORMS = """
spdx-license-identifier:\\s*(?:{n})(?![\\w.-])
(?:is |are |be )?(?:dual[- ])?licen[sc]ed\\s+under\\s+(?:the\\s+)?(?:terms\\s+of\\s+(?:the\\s+)?)?(?:{n})(?:[\\s,-]+licen[sc]e)?(?![\\w])
(?:released|distributed|published|available|made available)\\s+under\\s+(?:the\\s+)?(?:terms\\s+of\\s+(?:the\\s+)?)?(?:{n})(?:[\\s,-]+licen[sc]e)?(?![\\w])
(?:covered|governed)\\s+by\\s+(?:the\\s+)?(?:{n})(?:[\\s,-]+licen[sc]e)?(?![\\w])
subject\\s+to\\s+(?:the\\s+)?(?:terms\\s+of\\s+(?:the\\s+)?)?(?:{n})(?:[\\s,-]+licen[sc]e)(?![\\w])
licen[sc]e\\s*[:=]\\s*[\\"']?(?:{n})(?![\\w])
(?<![\\w])(?:the\\s+)?(?:{n})[\\s,-]+licen[sc]e(?:[\\s,]+(?:version\\s+|v)?[0-9]+(?:\\.[0-9]+)?)?(?![\\w])
(?<![\\w])licen[sc]e\\s+\\(?(?:{n})\\)?(?![\\w])
"""
#: Keyword that must occur for a form to be tried, in the order of FORMS ("over" stands in both covered and governed).
FORM_KEYS = ("spdx-license", "under", "under", "over", "subject", "licen", "licen", "licen")
# Label, then a passage of the license's own text or header; words are regular expressions, blanks stand for
# any white space and comment marks.
TEXTS = r"""
mit | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit | the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software
mit | the software is provided [^\w\s]*as is[^\w\s]* without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
apache | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an [^\w\s]*as is[^\w\s]* basis
apache | licensed under the apache license, version 2\.0 \(the [^\w\s]*license[^\w\s]*\);? you may not use this file except in compliance
apache | each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|patent|\(except as stated in this section\) patent) license
gpl | this (?:program|file|software) is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu general public license
gpl | you should have received a copy of the gnu general public license
gpl | the gnu general public license is a free, copyleft license for software and other kinds of works
gpl | the licenses for most software are designed to take away your freedom to share and change it
lgpl | this library is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | this library is distributed in the hope that it will be useful, but without any warranty
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license
lgpl | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
agpl | you can redistribute it and/or modify it under the terms of the gnu affero general public license
agpl | you should have received a copy of the gnu affero general public license
agpl | the gnu affero general public license is a free, copyleft license
bsd | redistribution and use in source and binary forms, with or without modification, are permitted
bsd | redistributions of source code must retain the (?:above )?copyright notice, this list of conditions and the following disclaimer
bsd | redistributions in binary form must reproduce the (?:above )?copyright notice, this list of conditions and the following disclaimer
bsd | neither the names? of .{1,200}? may be used to endorse or promote products derived from this software without specific
bsd | this software is provided by .{1,200}? [^\w\s]*as is[^\w\s]* and any express or implied warranties
mpl | this source code form is subject to the terms of the mozilla public license
mpl | the contents of this file are subject to the mozilla public license
mpl | if a copy of the mpl was not distributed with this file, you can obtain one at
epl | the accompanying program is provided under the terms of this eclipse public license
epl | this program and the accompanying materials are made available under the terms of the eclipse public license
cc0 | to the extent possible under law, .{1,200}? waived all copyright and related or neighboring rights
cc0 | affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders
cc-by-nc | licensed under (?:a|the) creative commons attribution[-\s]non-?commercial
cc-by-nc | you may not exercise any of the rights granted to you .{1,80}? primarily intended for or directed toward commercial advantage
cc-by-sa | licensed under (?:a|the) creative commons attribution[-\s]share-?alike
cc-by-sa | the adapter's license you apply must be a creative commons license with the same license elements
cc-by | by exercising the licensed rights .{1,80}? you accept and agree to be bound by the terms and conditions of this creative commons attribution [0-9.]+ international public license
isc | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that
isc | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
zlib | this software is provided [^\w\s]*as-is[^\w\s]* without any express or implied warranty
zlib | permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely
zlib | the origin of this software must not be misrepresented
zlib | altered source versions must be plainly marked as such
boost | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
boost | unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor
unlicense | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed
wtfpl | you just do what the fuck you want to
artistic | the intent of this document is to state the conditions under which a package may be copied
artistic | this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed
cddl | the contents of this file are subject to the terms of the common development and distribution license
cddl | when distributing covered (?:code|software), include this cddl header
eupl | licensed under the eupl
eupl | this european union public licence .{1,40}? applies to the work
ofl | this font software is licensed under the sil open font license
ofl | permission is hereby granted, free of charge, to any person obtaining a copy of the font software
psf | psf hereby grants licensee a nonexclusive, royalty-free, world-wide license
psf | this license agreement is between the python software foundation
ms-pl | this license governs use of the accompanying software. if you use the software, you accept this license
proprietary | unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|program)
proprietary | this software is the confidential and proprietary information of
"""
#: Between two words of such a passage.
GAP = r"[\s*#/;]+"
PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))


@dataclass(frozen=True)
class Rule:
    rank: int
    label: str
    pattern: str
    keys: tuple[str, str]


def _keyword(name: str) -> str:
    """Longest literal run that every match of a name holds (its optional parts and classes taken out)."""
    plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)[?*+]?|\[[^\]]*\][?*+]?|.\?|\\.", "\n", name)
    return max(re.findall(r"[a-z0-9]{2,}", plain), key=len, default="")


def _spaced(name: str) -> str:
    """A name whose blanks match any white space, since lines may be wrapped in it."""
    return re.sub(r" (?!\?)", r"\\s+", name.replace("[- ]", r"[-\s]")).replace(" ?", r"\s?")


def _text_rule(label: str, passage: str) -> Rule:
    """A passage of a license text: of the best rank, gated by its two longest plain words."""
    bare = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??|\[[^\]]*\][*?+]?", "\n", passage)
    plain = sorted({w for w in re.findall(r"(?<![^\s])[a-z]+(?=,?(?:\s|$))", bare)}, key=lambda w: (-len(w), w))
    pattern = passage.replace(",", ",?").replace("{1,?", "{1,").replace("/or)?", "/or)?").replace(" ", GAP)
    return Rule(0, label, "(?s)(?<![\\w])" + pattern, (plain[0], plain[1]))


def rules() -> list[Rule]:
    """The rules: passages of license texts, then statements in order of rank, each with a keyword of its form and one of its name."""
    forms = FORMS.strip().split("\n")
    names = [[x.strip() for x in line.split(" | ")] for line in FAMILIES.strip().split("\n")]
    texts = [_text_rule(*line.split(" | ")) for line in TEXTS.strip().split("\n")]
    return texts + [
        Rule(rank, label, form.replace("{n}", _spaced(name)), (key, _keyword(name)))
        for rank, (form, key) in enumerate(zip(forms, FORM_KEYS, strict=True))
        for label, *others in names
        for name in others
    ]


class Scanner:
    """Holds the automaton and the compiled rules of a task."""

    def __init__(self, table: list[Rule] | None = None, gated: bool = True):
        self.rules = rules() if table is None else table
        self.gated, self.compiled = gated, {}
        self.automaton = ahocorasick.Automaton()
        self.keys = sorted({k for r in self.rules for k in r.keys if k})
        for i, k in enumerate(self.keys):
            self.automaton.add_word(k, i)
        self.automaton.make_automaton()
        where = {k: i for i, k in enumerate(self.keys)}
        # words of which one at least stands in every text that any rule matches
        self.heads = sorted({r.keys[0] for r in self.rules})
        self.needs = [frozenset(where[k] for k in r.keys if k) for r in self.rules]

    def detections(self, lowered: str) -> list[tuple[int, int, int, str]]:
        """(start, end, rule, label) that survive rank and containment, by start."""
        if self.gated:
            if not any(k in lowered for k in self.heads):
                return []  # no rule has its first keyword
            seen = {i for _, i in self.automaton.iter(lowered)}
            tried = [i for i, need in enumerate(self.needs) if need <= seen]
        else:
            tried = range(len(self.rules))
        found = []
        for i in tried:
            if i not in self.compiled:
                self.compiled[i] = re.compile(self.rules[i].pattern)
            found += [(m.start(), m.end(), i, self.rules[i].label) for m in self.compiled[i].finditer(lowered)]
        kept: list[tuple[int, int, int, str]] = []
        for rank in sorted({self.rules[d[2]].rank for d in found}):
            # an interval is contained if one that starts no later, of a better rank or before it in this one, ends no earlier
            kept.sort()
            starts, reach = [k[0] for k in kept], list(accumulate((k[1] for k in kept), max))
            last = -1
            for d in sorted((d for d in found if self.rules[d[2]].rank == rank), key=lambda d: (d[0], -d[1], d[2])):
                before = bisect_right(starts, d[0])
                if d[1] > last and not (before and reach[before - 1] >= d[1]):
                    kept.append(d)
                    last = d[1]
        return sorted(kept)


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word position, label) of every base phrase."""
    places = []
    for i, w in enumerate(words):
        if w == b"license" and i:
            for phrase, label in PHRASES:
                parts = phrase.split()
                if words[max(0, i + 1 - len(parts)) : i + 1] == parts:
                    places.append((i + 1 - len(parts), label))
    return places


def scan_text(text: str | None, scanner: Scanner) -> tuple:
    data = lower_ascii(text)
    words = data.translate(_ALNUM).split()
    base = phrase_places(words) if b"license" in data else []
    found = scanner.detections(data.decode("utf-8", "surrogatepass"))
    base_labels, labels = {b for _, b in base}, {d[3] for d in found}
    doubt = 1.0
    for d in found:
        doubt *= 0.1 + 0.08 * scanner.rules[d[2]].rank
    score = 1.0 if base else 1 - doubt
    spans = ",".join(f"{d[3]}:{d[0]}:{d[1]}" for d in found)
    starts = [p for p, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)), score, spans)


def scan(docs: DataFrame, gated: bool = True) -> DataFrame:
    """Words, base phrase places, labels, score and the detections (label:start:end) of each text."""
    fields = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("spans", "string")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([("doc_id", pa.int64()), *[(n, kinds[k]) for n, k in fields]])
    holder: list[Scanner] = []

    def one(text: str | None) -> tuple:
        if not holder:
            holder.append(Scanner(gated=gated))
        return scan_text(text, holder[0])

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(per_row(["text"], schema, one, ["doc_id"]), "doc_id long, " + ", ".join(f"{n} {k}" for n, k in fields))
