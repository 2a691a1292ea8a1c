"""License scans by sentence-rule recognition.

A text is normalised to its words: lower case, without punctuation, comment leaders, quotes and line ends ("licence" is
written "license", a version like 2.0 is one word). Known licence sentences are found in the words by a table keyed by each
sentence's first words, the longest first, and mapped to their identifiers; so it doesn't matter over how many lines a
sentence runs or how long it is. Statements that name a licence ("under the terms of the GNU General Public License,
version 3") are known sentences with a variable part, put together from a table of names. The sequence of a document's
identifiers, in order, is then matched against the ordered table of licence rules, longest first: a rule names identifiers
that must follow each other, with at most MOST_BETWEEN unknown sentences (by ENDS) between two of them. What a rule has
matched is used up. Known sentences that no rule takes are reported as leftover.

`Licences` builds the table; further whole licence texts can be given to it by name, whose sentences are cut by the same ENDS.

A sentence can only be known if it holds one of ANCHORS, which is tested when the tables are compiled; texts without any
are passed over. Words are looked up from left to right and a rule's identifiers likewise, so time is linear in the text and
in its hits, whatever they are.

Defined results: a null or empty text has no licences (empty arrays); of sentences that begin at one word the longest counts
(the first in the table of equals); repeated rows are scanned each; an empty table gives an empty result; extra columns
aren't looked at; texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_arrow_batches, table, text_of

#: Every known sentence and statement holds one of these (any case), as a part of a word, as a whole word, or as a verb before "under".
ANCHORS = ("licen", "permission", "warrant", "copyright", "reserved", "domain", "redistribut", "software", "liable", "commons", "spdx", "gpl", "wtfpl", "cddl", "cc0")
WHOLE_WORDS = ("cc", "epl", "mpl")
VERBS = ("released", "distributed", "available", "published", "provided", "made")
#: Sentences of the standard texts and notices, with the identifier that each maps to. {v} stands for one word, which the identifier takes over.
SENTENCES = (
    ("all-rights-reserved", "All rights reserved"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-as-is", 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.'),
    ("mit-liability", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("mit-0-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc-as-is", 'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.'),
    ("isc-liability", "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-endorse", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-as-is", '"as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.'),
    ("bsd-liability", "be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("apache-comply", "you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-as-is", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("apache-text-{v}", "Apache License Version {v}, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("gpl-free", "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-free", "is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl-free", "is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation"),
    ("agpl-free", "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("or-later-{v}", "either version {v} of the License, or (at your option) any later version."),
    ("gpl-only-{v}", "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version {v} as published by the Free Software Foundation"),
    ("gpl-hope", "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-see", "See the GNU General Public License for more details."),
    ("lgpl-see", "See the GNU Lesser General Public License for more details."),
    ("agpl-see", "See the GNU Affero General Public License for more details."),
    ("gpl-received", "You should have received a copy of the GNU General Public License along with this program"),
    ("gpl-text-{v}", "GNU GENERAL PUBLIC LICENSE Version {v}, June 1991"),
    ("gpl-text-{v}", "GNU GENERAL PUBLIC LICENSE Version {v}, 29 June 2007"),
    ("lgpl-text-{v}", "GNU LESSER GENERAL PUBLIC LICENSE Version {v}, February 1999"),
    ("lgpl-text-{v}", "GNU LESSER GENERAL PUBLIC LICENSE Version {v}, 29 June 2007"),
    ("agpl-text-{v}", "GNU AFFERO GENERAL PUBLIC LICENSE Version {v}, 19 November 2007"),
    ("gpl-everyone", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("mpl-form-{v}", "This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}."),
    ("mpl-obtain", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl-text", 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").'),
    ("boost-grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("boost-notice", "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("boost-as-is", 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose, title and non-infringement.'),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-liability", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("unlicense-free", "This is free and unencumbered software released into the public domain."),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("public-domain", "released into the public domain"),
    ("public-domain", "is in the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("wtfpl-terms", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"),
    ("cc0-waive", "has waived all copyright and related or neighboring rights to"),
)

#: Names of licences in statements, and whether a version goes with the name. A name without the word license
#: counts only after a link ("under", "licensed under the terms of the", "license").
NAMES = (
    ("GNU Lesser General Public License", "LGPL", True),
    ("GNU Library General Public License", "LGPL", True),
    ("GNU Affero General Public License", "AGPL", True),
    ("GNU General Public License", "GPL", True),
    ("GNU Free Documentation License", "GFDL", True),
    ("GNU LGPL", "LGPL", True),
    ("GNU AGPL", "AGPL", True),
    ("GNU GPL", "GPL", True),
    ("LGPL", "LGPL", True),
    ("AGPL", "AGPL", True),
    ("GPL", "GPL", True),
    ("Apache License", "Apache", True),
    ("Apache Software License", "Apache", True),
    ("Apache", "Apache", True),
    ("MIT License", "MIT", False),
    ("MIT X11 License", "MIT", False),
    ("Expat License", "MIT", False),
    ("MIT", "MIT", False),
    ("ISC License", "ISC", False),
    ("ISC", "ISC", False),
    ("2-Clause BSD License", "BSD-2-Clause", False),
    ("BSD 2-Clause License", "BSD-2-Clause", False),
    ("BSD 2-Clause", "BSD-2-Clause", False),
    ("2-Clause BSD", "BSD-2-Clause", False),
    ("2-Clause License", "BSD-2-Clause", False),
    ("Simplified BSD License", "BSD-2-Clause", False),
    ("3-Clause BSD License", "BSD-3-Clause", False),
    ("BSD 3-Clause License", "BSD-3-Clause", False),
    ("BSD 3-Clause", "BSD-3-Clause", False),
    ("3-Clause BSD", "BSD-3-Clause", False),
    ("3-Clause License", "BSD-3-Clause", False),
    ("New BSD License", "BSD-3-Clause", False),
    ("Modified BSD License", "BSD-3-Clause", False),
    ("BSD License", "BSD", False),
    ("BSD", "BSD", False),
    ("Mozilla Public License", "MPL", True),
    ("MPL", "MPL", True),
    ("Eclipse Public License", "EPL", True),
    ("EPL", "EPL", True),
    ("Common Development and Distribution License", "CDDL", True),
    ("CDDL", "CDDL", True),
    ("Boost Software License", "BSL", True),
    ("Artistic License", "Artistic", True),
    ("Python Software Foundation License", "PSF", True),
    ("zlib License", "Zlib", False),
    ("zlib/libpng License", "Zlib", False),
    ("The Unlicense", "Unlicense", False),
    ("Unlicense", "Unlicense", False),
    ("WTFPL", "WTFPL", False),
    ("CC0", "CC-CC0", False),
    ("CC Zero", "CC-ZERO", False),
    ("Creative Commons Zero", "CC-ZERO", False),
    ("SIL Open Font License", "OFL", True),
)
#: The parts of Creative Commons licences, as code and spelled out; `names` puts them together.
CC_PREFIXES = ("cc", "creative commons")
CC_SPELLED = {"nc": ("nc", "noncommercial", "non commercial"), "sa": ("sa", "sharealike", "share alike"), "nd": ("nd", "noderivatives", "noderivs", "no derivatives")}
CC_KINDS = ((), ("nc",), ("sa",), ("nd",), ("nc", "sa"), ("nc", "nd"))

#: Words that link a statement to a licence's name: what it begins with, and what may stand between.
LINK_VERBS = frozenset("licensed released distributed available published provided made covered".split())
LINKS = frozenset("under license licensed".split())
BETWEEN = frozenset("the a an terms of and conditions with version is as this by".split())

#: Ordered rules: licence, identifiers in order. A * stands for the identifier's variable part, which the licence's name takes over.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT-0", ("mit-0-grant", "mit-as-is", "mit-liability")),
    ("MIT-0", ("mit-0-grant", "mit-as-is")),
    ("ISC", ("isc-grant", "isc-as-is", "isc-liability")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant", "mit-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-as-is", "isc-liability")),
    ("0BSD", ("0bsd-grant",)),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Apache-*", ("apache-ref-*", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-*", ("apache-ref-*", "apache-comply")),
    ("Apache-*", ("apache-text-*",)),
    ("GPL-*-or-later", ("gpl-free", "or-later-*", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-*-or-later", ("gpl-free", "or-later-*", "gpl-hope", "gpl-see")),
    ("GPL-*-or-later", ("gpl-free", "or-later-*")),
    ("GPL-*-only", ("gpl-only-*", "gpl-hope", "gpl-see", "gpl-received")),
    ("GPL-*-only", ("gpl-only-*", "gpl-hope", "gpl-see")),
    ("GPL-*-only", ("gpl-only-*",)),
    ("LGPL-*-or-later", ("lgpl-free", "or-later-*", "gpl-hope", "lgpl-see")),
    ("LGPL-*-or-later", ("lgpl-free", "or-later-*")),
    ("AGPL-*-or-later", ("agpl-free", "or-later-*", "gpl-hope", "agpl-see")),
    ("AGPL-*-or-later", ("agpl-free", "or-later-*")),
    ("GPL-*", ("gpl-text-*", "gpl-everyone")),
    ("GPL-*", ("gpl-text-*",)),
    ("LGPL-*", ("lgpl-text-*", "gpl-everyone")),
    ("LGPL-*", ("lgpl-text-*",)),
    ("AGPL-*", ("agpl-text-*", "gpl-everyone")),
    ("AGPL-*", ("agpl-text-*",)),
    ("MPL-*", ("mpl-form-*", "mpl-obtain")),
    ("MPL-*", ("mpl-form-*",)),
    ("EPL-*", ("epl-ref-*", "epl-text")),
    ("BSL-*", ("bsl-ref-*", "boost-grant", "boost-notice", "boost-as-is")),
    ("BSL-1.0", ("boost-grant", "boost-notice", "boost-as-is")),
    ("BSL-1.0", ("boost-grant", "boost-notice")),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin")),
    ("Zlib", ("zlib-grant", "zlib-origin")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("WTFPL", ("wtfpl-terms",)),
    ("CC-CC0", ("cc0-waive",)),
    ("SPDX-*", ("spdx-*",)),
    ("public-domain", ("public-domain",)),
    ("all-rights-reserved", ("copyright-holder", "all-rights-reserved")),
    ("all-rights-reserved", ("all-rights-reserved",)),
    ("copyright", ("copyright-holder",)),
)
MOST_BETWEEN = 3

#: A name written together with its version is two words (GPLv3).
WORD = re.compile(r"\([cC]\)|©|(?i:[al]?gpl|epl|mpl)(?=v?\d)|[^\W_]+(?:\.\d+)*")
NUMBER = re.compile(r"v?(\d+(?:\.\d+)*)")
YEAR = re.compile(r"(?:19|20)\d\d")
SPDX = re.compile(r"spdx-license-identifier:[ \t]*([a-z0-9.+-]+(?:[ \t]+(?:or|and|with)[ \t]+[a-z0-9.+-]+)*)", re.I)
ENDS = re.compile(r"(?<=[.!?;])\s+|\n\s*\n")
CLOSING = re.compile(r"[.;:!?)\"'”’]*")
WHOLE = re.compile(rf"\b(?:{'|'.join(WHOLE_WORDS)})\b")
UNDER = re.compile(rf"(?:{'|'.join(VERBS)})\s+under")
#: A sentence is looked up by this many of its first words.
FIRST = 2
Found = tuple[int, int, int, int, str, str]


def anchored(text: str) -> bool:
    """Whether a text holds an anchor: plain searches first, a pattern only where they leave it open."""
    low = text.lower()
    if any(a in low for a in ANCHORS):
        return True
    return any(w in low for w in WHOLE_WORDS) and bool(WHOLE.search(low)) or "under" in low and any(v in low for v in VERBS) and bool(UNDER.search(low))


def tables_hold() -> bool:
    """Every known sentence and linked name has an anchor."""
    linked = all(anchored(x if "license" in x.lower() or anchored(x) else f"released under {x}") for x, _, _ in NAMES)
    return linked and all(anchored(s) for name, s in SENTENCES if not name.startswith("or-later"))


def words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) in order: lower case, "licence" as "license", a copyright sign as "(c)"."""
    out = []
    for m in WORD.finditer(text):
        w = m[0].lower()
        out.append(("license" if w == "licence" else "(c)" if w == "©" else w, m.start(), m.end()))
    return out


def names() -> Iterator[tuple[tuple[str, ...], str, bool]]:
    """(words, licence, versioned) of every name: NAMES, and the Creative Commons licences from their parts."""
    for name, licence, versioned in NAMES:
        yield tuple(w for w, _, _ in words(name)), licence, versioned
    for prefix, by, kinds in product(CC_PREFIXES, ("by", "attribution"), CC_KINDS):
        for parts in product(*(CC_SPELLED[k] for k in kinds)):
            yield (*prefix.split(), by, *" ".join(parts).split()), "-".join(["CC", "BY", *map(str.upper, kinds)]), False


class Licences:
    """The tables: sentences and names by their first words, and the ordered rules.

    texts: further whole licence texts by name; each one's sentences, cut by ENDS, get the identifiers name#0, name#1, ...,
    and the licence a rule of all of them that comes before the others.
    """

    def __init__(self, texts: Mapping[str, str] | None = None):
        sentences, rules = list(SENTENCES), list(RULES)
        for name, text in (texts or {}).items():
            cut = [s for s in ENDS.split(text) if len(words(s)) >= FIRST and anchored(s)]
            sentences += [(f"{name}#{i}", s) for i, s in enumerate(cut)]
            rules.insert(0, (name, tuple(f"{name}#{i}" for i in range(len(cut)))))
        self.sentences: dict[tuple[str, ...], list[tuple[tuple[str, ...], int | None, str]]] = {}
        for name, sentence in sentences:
            w = tuple(x for x, _, _ in words(sentence.replace("{v}", "xvx")))
            slot = w.index("xvx") if "xvx" in w else None
            self.sentences.setdefault(w[:FIRST], []).append((w, slot, name.replace("-{v}", "")))
        for known in self.sentences.values():
            known.sort(key=lambda k: -len(k[0]))
        self.names: dict[str, list[tuple[tuple[str, ...], str, bool]]] = {}
        for n in names():
            self.names.setdefault(n[0][0], []).append(n)
        for n in self.names.values():
            n.sort(key=lambda x: -len(x[0]))
        statements = [(f"{licence}-*" if versioned else licence, (f"{licence.lower()}-ref" + ("-*" if versioned else ""),)) for licence, versioned in dict.fromkeys((x, v) for _, x, v in names())]
        statements += [(licence.removesuffix("-*"), (ids[0].removesuffix("-*"),)) for licence, ids in statements if licence.endswith("-*")]
        self.rules = [*rules[:-3], *statements, *rules[-3:]]  # copyright lines come last

    def known(self, text: str) -> list[Found]:
        """(number of the sentence it starts in, of the one it ends in, start, end, identifier, variable part) of the known sentences of a text, in order."""
        if not anchored(text):
            return []
        found = words(text)
        w = [x for x, _, _ in found]
        spdx = {m.start(): m for m in SPDX.finditer(text)}
        hits: list[tuple[int, int, str, str]] = []
        link = -1  # first word of the linking words just before, -1 if there are none
        i, n = 0, len(w)
        while i < n:
            word, at, _ = found[i]
            hit = self.at(w, i, n, link)
            if at in spdx and w[i] == "spdx":
                m = spdx[at]
                hits.append((at, m.end(), "spdx", m[1].upper()))
                while i < n and found[i][1] < m.end():
                    i += 1
                link = -1
            elif hit:
                last, name, value, first = hit
                end = CLOSING.match(text, found[last - 1][2]).end()
                hits.append((found[first][1], end, name, value))
                goes_on = name.endswith("-ref") and last < n and w[last] in ("or", "and")  # the next name has the same link
                i, link = (last + 1, last + 1) if goes_on else (last, -1)
            elif word == "copyright" and i + 1 < n and (w[i + 1] == "(c)" or YEAR.fullmatch(w[i + 1])):
                hits.append((at, -1, "copyright-holder", ""))
                i, link = i + 2, -1
            else:
                if word in LINKS:
                    link = i - 1 if link < 0 and i and w[i - 1] in LINK_VERBS else i if link < 0 else link
                elif word not in BETWEEN:
                    link = -1
                i += 1
        return numbered(text, hits)

    def at(self, w: list[str], i: int, n: int, link: int) -> tuple[int, str, str, int] | None:
        """(one past the last word, identifier, variable part, first word) of what is known from word i on."""
        for known, slot, name in self.sentences.get(tuple(w[i : i + FIRST]), ()):
            k = len(known)
            if i + k > n:
                continue
            if slot is None:
                if tuple(w[i : i + k]) == known:
                    return i + k, name, "", i
            elif tuple(w[i : i + slot]) == known[:slot] and tuple(w[i + slot + 1 : i + k]) == known[slot + 1 :]:
                return i + k, name, w[i + slot], i
        for known, licence, versioned in self.names.get(w[i], ()):
            k = i + len(known)
            if tuple(w[i:k]) != known or not ("license" in known or link >= 0 or k < n and w[k] == "license"):
                continue
            if k < n and w[k] == "license" and "license" not in known:
                k += 1
            value = ""
            if versioned:
                j = k + (k < n and w[k] in ("version", "v", "ver"))
                if j < n and (m := NUMBER.fullmatch(w[j])):
                    value, k = m[1], j + 1
                    for later in (("or", "later"), ("or", "any", "later", "version"), ("or", "at", "your", "option", "any", "later", "version")):
                        if tuple(w[k : k + len(later)]) == later:
                            value, k = f"{value}-or-later", k + len(later)
                            break
            return k, f"{licence.lower()}-ref", value, link if link >= 0 else i
        return None

    def recognised(self, found: list[Found]) -> tuple[list[tuple[str, int, int]], list[str]]:
        """(licence, start, end) by the ordered rules, in order of place, and the identifiers that no rule takes."""
        free, out = list(range(len(found))), []
        there = {f[4] for f in found}
        for licence, rule in self.rules:
            if not free:
                break
            if rule[0].removesuffix("-*") not in there:
                continue
            left, i = [], 0
            while i < len(free):
                part = self.matched(rule, found, free, i)
                if part is None:
                    left.append(free[i])
                    i += 1
                else:
                    last = i + len(rule)
                    out.append((licence.replace("*", part), found[free[i]][2], found[free[last - 1]][3]))
                    i = last
            free = left
        out.sort(key=lambda x: (x[1], x[2], x[0]))
        return out, [written(found[i]) for i in free]

    @staticmethod
    def matched(rule: tuple[str, ...], found: list[Found], free: list[int], i: int) -> str | None:
        """The variable part if the free hits from the i-th on are the rule's identifiers, None if they aren't."""
        if i + len(rule) > len(free):
            return None
        part = ""
        for k, want in enumerate(rule):
            f = found[free[i + k]]
            if k and f[0] - found[free[i + k - 1]][1] - 1 > MOST_BETWEEN:
                return None
            if want.endswith("-*"):
                if f[4] != want[:-2] or not f[5]:
                    return None
                part = f[5]
            elif f[4] != want or (f[5] and want.endswith("-ref")):
                return None
        return part


def written(f: Found) -> str:
    """The identifier with its variable part."""
    return f"{f[4]}-{f[5]}" if f[5] else f[4]


def numbered(text: str, hits: list[tuple[int, int, str, str]]) -> list[Found]:
    """Hits with the numbers of the sentences they start and end in; a copyright line ends with its line or before the next hit."""
    ends = [m.end() for m in ENDS.finditer(text)] if hits else []
    out, k = [], 0
    for j, (a, b, name, value) in enumerate(hits):
        if b < 0:
            limit = hits[j + 1][0] if j + 1 < len(hits) else len(text)
            stop = text.find("\n", a, limit)
            b = a + len(text[a : limit if stop < 0 else stop].rstrip())
        while k < len(ends) and ends[k] <= a:
            k += 1
        first = k
        while k < len(ends) and ends[k] < b:
            k += 1
        out.append((first, k, a, b, name, value))
    return out


@lru_cache(maxsize=1)
def standard() -> Licences:
    return Licences()


def known(text: str) -> list[Found]:
    return standard().known(text)


def recognised(found: list[Found]) -> tuple[list[tuple[str, int, int]], list[str]]:
    return standard().recognised(found)


HIT = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = "doc_id long, licenses array<string>, hits array<struct<license:string,start:long,end:long>>, sentences array<string>, leftover array<string>"


def licenses(docs: DataFrame, texts: Mapping[str, str] | None = None) -> DataFrame:
    """doc_id, licenses (distinct, sorted), hits (with code point spans), sentences (identifiers in order), leftover; a row for each row of docs.

    texts: further whole licence texts by name, for the tables.
    """
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Licences(texts) if texts else standard()
        for b in batches:
            hits, ids, left = [], [], []
            for text in b.column(1).to_pylist():
                found = tables.known(text)
                h, rest = tables.recognised(found)
                hits.append([{"license": x, "start": s, "end": e} for x, s, e in h])
                ids.append([written(f) for f in found])
                left.append(rest)
            strings = pa.list_(pa.string())
            distinct = pa.array([sorted({x["license"] for x in h}) for h in hits], strings)
            yield pa.RecordBatch.from_arrays([b.column(0), distinct, pa.array(hits, pa.list_(HIT)), pa.array(ids, strings), pa.array(left, strings)], ["doc_id", "licenses", "hits", "sentences", "leftover"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
