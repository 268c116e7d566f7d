"""Licence scans by sentence rules: known licence sentences become identifiers, and rules match ordered sequences of them."""

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, schema, text_of

# SPDX identifier, family, and the names by which sentences call the licence.
LICENCES = [
    ("0BSD", "permissive", ["BSD Zero Clause License"]),
    ("AFL-3.0", "permissive", ["Academic Free License version 3.0"]),
    ("AGPL-3.0-only", "copyleft", ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3"]),
    ("AGPL-3.0-or-later", "copyleft", ["GNU Affero General Public License, version 3 or later", "GNU Affero General Public License v3.0 or later"]),
    ("Apache-1.1", "permissive", ["Apache Software License, Version 1.1"]),
    ("Apache-2.0", "permissive", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"]),
    ("APSL-2.0", "weak copyleft", ["Apple Public Source License, version 2.0"]),
    ("Artistic-1.0", "permissive", ["Artistic License 1.0"]),
    ("Artistic-2.0", "permissive", ["Artistic License 2.0", "Artistic License, version 2.0"]),
    ("BlueOak-1.0.0", "permissive", ["Blue Oak Model License 1.0.0"]),
    ("BSD-1-Clause", "permissive", ["BSD 1-Clause License"]),
    ("BSD-2-Clause", "permissive", ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"]),
    ("BSD-3-Clause", "permissive", ["BSD 3-Clause License", "New BSD License", "Modified BSD License"]),
    ("BSD-4-Clause", "permissive", ["BSD 4-Clause License", "Original BSD License"]),
    ("BSL-1.0", "permissive", ["Boost Software License, Version 1.0", "Boost Software License - Version 1.0"]),
    ("BUSL-1.1", "source available", ["Business Source License 1.1"]),
    ("CC-BY-2.0", "permissive", ["CC BY 2.0", "Creative Commons Attribution 2.0 Generic License"]),
    ("CC-BY-3.0", "permissive", ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"]),
    ("CC-BY-4.0", "permissive", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-NC-3.0", "non-commercial", ["CC BY-NC 3.0"]),
    ("CC-BY-NC-4.0", "non-commercial", ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC-BY-NC-ND-4.0", "non-commercial", ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"]),
    ("CC-BY-NC-SA-4.0", "non-commercial", ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"]),
    ("CC-BY-ND-4.0", "no derivatives", ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"]),
    ("CC-BY-SA-3.0", "copyleft", ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"]),
    ("CC-BY-SA-4.0", "copyleft", ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("CC0-1.0", "public domain", ["CC0 1.0", "Creative Commons CC0 1.0 Universal license"]),
    ("CDDL-1.0", "weak copyleft", ["Common Development and Distribution License, Version 1.0", "CDDL 1.0"]),
    ("CDDL-1.1", "weak copyleft", ["Common Development and Distribution License, Version 1.1"]),
    ("CECILL-2.1", "copyleft", ["CeCILL license, version 2.1", "CeCILL 2.1"]),
    ("CPL-1.0", "weak copyleft", ["Common Public License Version 1.0", "Common Public License - v 1.0"]),
    ("ECL-2.0", "permissive", ["Educational Community License, Version 2.0"]),
    ("Elastic-2.0", "source available", ["Elastic License 2.0"]),
    ("EPL-1.0", "weak copyleft", ["Eclipse Public License v1.0", "Eclipse Public License, version 1.0"]),
    ("EPL-2.0", "weak copyleft", ["Eclipse Public License v2.0", "Eclipse Public License 2.0", "Eclipse Public License, version 2.0"]),
    ("EUPL-1.2", "copyleft", ["European Union Public Licence v1.2", "EUPL, Version 1.2"]),
    ("GFDL-1.3-or-later", "copyleft", ["GNU Free Documentation License, version 1.3 or later"]),
    ("GPL-1.0-or-later", "copyleft", ["GNU General Public License, version 1 or later"]),
    ("GPL-2.0-only", "copyleft", ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2 license"]),
    ("GPL-2.0-or-later", "copyleft", ["GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later", "GNU GPL v2 or later"]),
    ("GPL-3.0", "copyleft", ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3 license"]),
    ("GPL-3.0-only", "copyleft", []),
    ("GPL-3.0-or-later", "copyleft", ["GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later", "GNU GPL v3 or later"]),
    ("HPND", "permissive", ["Historical Permission Notice and Disclaimer"]),
    ("IPL-1.0", "weak copyleft", ["IBM Public License Version 1.0"]),
    ("ISC", "permissive", ["ISC License"]),
    ("LGPL-2.0-or-later", "weak copyleft", ["GNU Library General Public License, version 2 or later"]),
    ("LGPL-2.1-only", "weak copyleft", ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"]),
    ("LGPL-2.1-or-later", "weak copyleft", ["GNU Lesser General Public License, version 2.1 or later"]),
    ("LGPL-3.0-only", "weak copyleft", ["GNU Lesser General Public License, version 3", "GNU LGPL v3"]),
    ("LGPL-3.0-or-later", "weak copyleft", ["GNU Lesser General Public License, version 3 or later"]),
    ("LPPL-1.3c", "weak copyleft", ["LaTeX Project Public License, version 1.3c"]),
    ("MIT", "permissive", ["MIT License", "MIT/X11 License", "Expat License"]),
    ("MIT-0", "permissive", ["MIT No Attribution License"]),
    ("MPL-1.1", "weak copyleft", ["Mozilla Public License Version 1.1"]),
    ("MPL-2.0", "weak copyleft", ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0"]),
    ("MS-PL", "permissive", ["Microsoft Public License"]),
    ("MS-RL", "weak copyleft", ["Microsoft Reciprocal License"]),
    ("NCSA", "permissive", ["University of Illinois/NCSA Open Source License"]),
    ("ODbL-1.0", "copyleft", ["Open Database License v1.0", "Open Data Commons Open Database License v1.0"]),
    ("OFL-1.1", "permissive", ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"]),
    ("OpenSSL", "permissive", ["OpenSSL license"]),
    ("OSL-3.0", "copyleft", ["Open Software License version 3.0", "Open Software License 3.0"]),
    ("PHP-3.01", "permissive", ["PHP License, version 3.01"]),
    ("PostgreSQL", "permissive", ["PostgreSQL License"]),
    ("PSF-2.0", "permissive", ["Python Software Foundation License Version 2"]),
    ("QPL-1.0", "weak copyleft", ["Q Public License version 1.0"]),
    ("SSPL-1.0", "source available", ["Server Side Public License, version 1"]),
    ("Unicode-DFS-2016", "permissive", []),
    ("Unlicense", "public domain", ["Unlicense"]),
    ("UPL-1.0", "permissive", ["Universal Permissive License v 1.0", "Universal Permissive License (UPL), Version 1.0"]),
    ("W3C", "permissive", ["W3C Software Notice and License"]),
    ("WTFPL", "public domain", ["Do What The Fuck You Want To Public License, Version 2"]),
    ("X11", "permissive", ["X11 License"]),
    ("ZPL-2.1", "permissive", ["Zope Public License, Version 2.1"]),
    ("Zlib", "permissive", ["zlib License", "zlib/libpng License"]),
]

# Sentences that name a licence; each stands with and without `the` before the name, where it has one.
NAMING = ["Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}", "This file is licensed under {}", "Published under {}"]

# SPDX exceptions that a tag may add to a licence.
EXCEPTIONS = ["Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "OpenSSL-exception", "Linux-syscall-note"]

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache.header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache.copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache.asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache.see": "See the License for the specific language governing permissions and limitations under the License",
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl2.free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl.short": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense.public": "This is free and unencumbered software released into the public domain",
    "lgpl21.free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3.free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl.hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "agpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2only.free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "classpath.link": "As a special exception, the copyright holders of this library give you permission to link this library with independent modules to produce an executable, regardless of the license terms of these independent modules, and to copy and distribute the resulting executable under terms of your choice",
    "bsd.ad": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "isc.asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd0.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "boost.grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "zlib.asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "epl2.terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution",
    "epl2.terms2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "epl1.terms": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "cddl.terms": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")",
    "mpl11.terms": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License",
    "rights.reserved": "All rights reserved",
}
for _id, _, _names in LICENCES:  # by rule: a tag for each, and each naming sentence with each name
    SENTENCES[f"{_id}.spdx"] = f"SPDX-License-Identifier: {_id}"
    SENTENCES |= {f"{_id}.named{i}.{j}{the[:1]}": say.format(the + name) for i, say in enumerate(NAMING) for j, name in enumerate(_names) for the in ("", "the ")}
    SENTENCES |= {f"{_id}.with.{x}": f"SPDX-License-Identifier: {_id} WITH {x}" for x in EXCEPTIONS}

# Fixed values: (identifier, openings, core, last word) of known sentences that name a holder: any words may stand between these pieces.
NAMED = [
    ("bsd.names", ("neither",), "may be used to endorse or promote products derived from this software without", "permission"),
    ("bsd.names", ("the name", "the names"), "may not be used to endorse or promote products derived from this software without", "permission"),
]

# Fixed values: (licence, family, sequence of sentence identifiers), tried in this order at each sentence.
RULES = [
    ("Apache-2.0", "permissive", ("apache.header", "apache.copy", "apache.asis", "apache.see")),
    ("Apache-2.0", "permissive", ("apache.header", "apache.copy")),
    ("Apache-2.0", "permissive", ("apache.header",)),
    ("MIT", "permissive", ("mit.grant", "mit.notice", "mit.asis")),
    ("MIT", "permissive", ("mit.grant", "mit.notice")),
    ("GPL-3.0-or-later WITH Classpath-exception-2.0", "weak copyleft", ("gpl.free", "gpl.hope", "classpath.link")),
    ("GPL-3.0-or-later", "copyleft", ("gpl.free", "gpl.hope")),
    ("GPL-3.0-or-later", "copyleft", ("gpl.free",)),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", "weak copyleft", ("gpl2.free", "gpl.hope", "classpath.link")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2.free", "gpl.hope")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2.free",)),
    ("GPL-2.0-only WITH Classpath-exception-2.0", "weak copyleft", ("gpl2only.free", "gpl.hope", "classpath.link")),
    ("GPL-2.0-only", "copyleft", ("gpl2only.free",)),
    ("LGPL-2.1-or-later", "weak copyleft", ("lgpl21.free", "lgpl.hope")),
    ("LGPL-2.1-or-later", "weak copyleft", ("lgpl21.free",)),
    ("LGPL-3.0-or-later", "weak copyleft", ("lgpl3.free", "lgpl.hope")),
    ("LGPL-3.0-or-later", "weak copyleft", ("lgpl3.free",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl.free", "gpl.hope")),
    ("AGPL-3.0-or-later", "copyleft", ("agpl.free",)),
    ("BSD-4-Clause", "permissive", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.ad", "bsd.names")),
    ("BSD-3-Clause", "permissive", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-2-Clause", "permissive", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("BSD-1-Clause", "permissive", ("bsd.grant", "bsd.source")),
    ("ISC", "permissive", ("isc.grant",)),
    ("0BSD", "permissive", ("bsd0.grant", "isc.asis")),
    ("BSL-1.0", "permissive", ("boost.grant",)),
    ("Zlib", "permissive", ("zlib.asis", "zlib.grant")),
    ("EPL-2.0", "weak copyleft", ("epl2.terms",)),
    ("EPL-2.0", "weak copyleft", ("epl2.terms2",)),
    ("EPL-1.0", "weak copyleft", ("epl1.terms",)),
    ("CDDL-1.0", "weak copyleft", ("cddl.terms",)),
    ("MPL-1.1", "weak copyleft", ("mpl11.terms",)),
    ("MPL-2.0", "weak copyleft", ("mpl.short",)),
    ("Unlicense", "public domain", ("unlicense.public",)),
    ("All-Rights-Reserved", "reserved", ("rights.reserved",)),
]
for _id, _family, _ in LICENCES:  # by rule: a sentence that names a licence is one
    RULES += [(f"{_id} WITH {k.split('.with.')[1]}" if ".with." in k else _id, _family, (k,)) for k in SENTENCES if k.startswith((f"{_id}.spdx", f"{_id}.named", f"{_id}.with."))]

_WORD = re.compile(r"[0-9a-z]+(?:[.\-/][0-9a-z]+)*")
#: Words, in group 1, and the comment marks that are letters at the head of a line.
_MARK = r"(?:dnl|rem|c)(?=\s)"
_TOKEN = re.compile(rf"^[^0-9a-z\n]*{_MARK}|({_WORD.pattern})", re.MULTILINE)
#: Where sentences are cut: at their ends or blank lines, at lines too, at the marks of block comments too.
_CUTS = [re.compile(r"[.!?;:]+(?=\s|$)" + more) for more in (r"|\n\s*\n", r"|\n", r"|\n|/\*|\*/|<!--|-->")]
#: What a copyright notice begins with, up to its year.
_NOTICE = re.compile(rf"\W*(?:{_MARK}\W*)?(?:copyright\b|\(c\)|©).*\d{{4}}", re.IGNORECASE | re.DOTALL)
#: Known sentences of so many words can begin anywhere; shorter ones only where a sentence, line or comment does, or after a copyright notice.
_LONG = 16
#: Each known sentence has one of these words (checked below); a text without them has no known sentence.
_TRIGGER = re.compile(r"licen[sc]|permission|warrant|redistribut|copyright|rights|distributed|unencumbered|released under|published under|made available|subject to|advertising", re.IGNORECASE)
assert all(_TRIGGER.search(s) for s in SENTENCES.values())
#: Most characters between two sentences of a rule.
GAP = 1_000


def normalise(sentence: str) -> str:
    """Lower-case words of letters and digits, joined by single spaces; points, hyphens and slashes stay inside words."""
    return " ".join(_WORD.findall(sentence.lower()))


def _known() -> dict[tuple[str, str], dict[int, dict[tuple[str, ...], str]]]:
    """first two words -> length -> words -> identifier, of the known sentences; tags are read by _tags()."""
    out: dict[tuple[str, str], dict[int, dict[tuple[str, ...], str]]] = {}
    for k, s in SENTENCES.items():
        words = tuple(normalise(s).split(" "))
        if words[0] != _TAG:
            out.setdefault(words[:2], {}).setdefault(len(words), {})[words] = k
    return out


_TAG = "spdx-license-identifier"
_IDS = {_id.lower(): _id for _id, _, _ in LICENCES}
_WITH = {x.lower(): x for x in EXCEPTIONS}
_KNOWN = _known()


class _Words:
    """A whole text's words in lower case, and the cuts between them."""

    def __init__(self, text: str):
        low = text.lower()
        if len(low) != len(text):  # the few letters that grow are in no known sentence
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        self.text, self.spans = text, [m.span(1) for m in _TOKEN.finditer(low) if m[1]]
        self.words = [low[a:b] for a, b in self.spans]
        self.cuts = [[m.end() for m in at.finditer(text)] for at in _CUTS]

    def left(self, cuts: list[int], i: int) -> int | None:
        """The last cut between word i and the word before, if any."""
        c = bisect.bisect(cuts, self.spans[i][0])
        if c and (i == 0 or cuts[c - 1] > self.spans[i - 1][1]):
            return cuts[c - 1]
        return None if i else 0

    def right(self, cuts: list[int], i: int) -> int | None:
        """The first cut between word i and the next word, if any."""
        c, last = bisect.bisect(cuts, self.spans[i][1]), i + 1 == len(self.spans)
        if c < len(cuts) and (last or cuts[c] <= self.spans[i + 1][0]):
            return cuts[c]
        return len(self.text) if last else None

    def noticed(self, i: int) -> bool:
        """Whether a copyright notice stands between word i and the last cut before it."""
        c = bisect.bisect(self.cuts[-1], self.spans[i][0])
        return bool(_NOTICE.match(self.text, self.cuts[-1][c - 1] if c else 0, self.spans[i][0]))


def _named(t: _Words) -> list[tuple[int, int, str]]:
    """Known sentences with a holder's name: the nearest opening before each core, and the nearest last word after it. They may begin
    and end anywhere."""
    found = []
    for k, openings, core, last in NAMED:
        core, openings = core.split(" "), [o.split(" ") for o in openings]
        at = [i for i, pair in enumerate(zip(t.words, t.words[1:], strict=False)) if pair == (core[0], core[1]) and t.words[i : i + len(core)] == core]
        ends = [i + len(core) for i in at]
        for i, end, before, after in zip(at, ends, [0, *ends], [*at[1:], len(t.words)], strict=False):  # not into the next core
            first = next((p for p in range(i - 1, before - 1, -1) if any(t.words[p : p + len(o)] == o for o in openings)), None)
            j = next((p for p in range(end, after) if t.words[p] == last), None)
            if first is not None and j is not None:
                spans = [(t.left(cuts, first), t.right(cuts, j)) for cuts in t.cuts]
                spans = [(a, b) for a, b in spans if a is not None and b is not None]
                found.append((*max(spans, key=lambda x: x[1] - x[0], default=(t.spans[first][0], t.spans[j][1])), k))
    return found


def _tags(t: _Words) -> list[tuple[int, int, str]]:
    """A tag's licences, joined by `and` or `or`, each perhaps `with` an exception: one identifier for each."""
    found = []
    for i, word in enumerate(t.words):
        j = i + 1
        while word == _TAG and j < len(t.words) and t.words[j] in _IDS:
            k, first = _IDS[t.words[j]], i if j == i + 1 else j
            more = t.words[j + 1 : j + 3]
            if len(more) == 2 and more[0] == "with" and more[1] in _WITH:
                k, j = f"{k}.with.{_WITH[more[1]]}", j + 2
            else:
                k += ".spdx"
            found.append((t.spans[first][0], t.spans[j][1], k))
            if t.words[j + 1 : j + 2] not in (["or"], ["and"]):
                break
            j += 2
    return found


def sentences(text: str) -> list[tuple[str, int, int]]:
    """Known sentences of a whole text, in order: (identifier, start, end) in characters.

    They are compared word by word, so a sentence may be broken over any number of lines, with comment marks between. It ends where a
    sentence, a line or a comment does; of known sentences that overlap, the longer wins, and any over one with a holder's name between."""
    found, t = [], _Words(text)
    for i, pair in enumerate(zip(t.words, t.words[1:], strict=False)):
        for n, known in _KNOWN.get(pair, {}).items():
            k, j = known.get(tuple(t.words[i : i + n])), i + n - 1
            if k is None or (end := t.right(t.cuts[-1], j)) is None:
                continue
            for cuts in t.cuts:
                a, b = t.left(cuts, i), t.right(cuts, j)
                if a is not None and b is not None:
                    found.append((a, b, k))
            if t.left(t.cuts[-1], i) is None and (n >= _LONG or t.noticed(i)):
                found.append((t.spans[i][0], end, k))
    longest = lambda x: sorted(set(x), key=lambda f: (f[0] - f[1], f[0], f[2]))
    kept: list[tuple[int, int, str]] = []
    for f in [*longest(found), *longest(_named(t)), *longest(_tags(t))]:  # kept ones don't overlap, so the neighbours by start are enough
        i = bisect.bisect(kept, f)
        if (i == 0 or kept[i - 1][1] <= f[0]) and (i == len(kept) or f[1] <= kept[i][0]):
            kept.insert(i, f)
    return [(k, a, b) for a, b, k in kept]


_BY_FIRST: dict[str, list[int]] = {}
for _r, (_, _, _seq) in enumerate(RULES):
    _BY_FIRST.setdefault(_seq[0], []).append(_r)


def match_rules(found: list[tuple[str, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """(rule, first, end) of the rules found in a sequence of sentences (identifier, start, end): left to right, the first rule that fits,
    without overlap. Sentences of a rule follow each other with at most `gap` characters between two."""
    out, i = [], 0
    while i < len(found):
        for r in _BY_FIRST.get(found[i][0], ()):
            seq = RULES[r][2]
            part = found[i : i + len(seq)]
            if tuple(k for k, _, _ in part) == seq and all(b[1] - a[2] <= gap for a, b in zip(part, part[1:], strict=False)):
                out.append((r, i, i + len(seq)))
                i += len(seq)
                break
        else:
            i += 1
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text_list = pa.list_(pa.string())
    match = pa.list_(pa.struct([("licence", pa.string()), ("rule", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            known, licences, families, matches = [], [], [], []
            for text in text_of(batch)[lo : lo + 1024]:
                text = text.as_py()
                got = sentences(text) if text and _TRIGGER.search(text) else []
                hits = match_rules(got)
                known.append([k for k, _, _ in got])
                licences.append(sorted({RULES[r][0] for r, _, _ in hits}))
                families.append(sorted({RULES[r][1] for r, _, _ in hits}))
                matches.append([{"licence": RULES[r][0], "rule": r, "start": got[a][1], "end": got[b - 1][2]} for r, a, b in hits])
            cols = [batch.column("key")[lo : lo + 1024], pa.array(known, text_list), pa.array(licences, text_list), pa.array(families, text_list), pa.array(matches, match)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "sentence_ids", "licences", "families", "matches"])


def scan(docs: DataFrame, keys: list[str]) -> DataFrame:
    """docs(keys, text) -> key (a struct of the keys, whose names may be any), sentence_ids (known sentences in order), licences, families
    (sorted, distinct), matches (licence, rule, start and end in characters).

    Reads whole texts. Null texts and texts without known sentences have empty arrays; repeated rows stay; an empty table gives none."""
    rows = keyed(docs, keys)
    match = "array<struct<licence: string, rule: int, start: int, end: int>>"
    return rows.mapInArrow(_scan, schema(f"key int, sentence_ids array<string>, licences array<string>, families array<string>, matches {match}", key=rows.schema["key"].dataType))
