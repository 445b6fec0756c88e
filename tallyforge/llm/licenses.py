"""Licence scans by sentence rules: known sentences become identifiers, identifier sequences meet ordered rules.

Sentences are templates: a slot, ``{}``, stands for up to twelve words, such as a holder's name.  A sentence is found at
any word of a text, so a notice may stand before it on its line; of several that fit at a place the longest counts, so a
longer name or condition excludes the shorter one.  Names of licences in the usual phrases, and the identifiers of tags,
are sentences too, made by rule; a phrase after "not" does not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _run as R

#: Sentences of public licences and of the notices that name them, by identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-head": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "ccbync-notice": "Licensed under CC BY-NC 4.0.",
    "ccby-notice": "Licensed under CC BY 4.0.",
    "ccbysa-notice": "Licensed under CC BY-SA 4.0.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-redistribute": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl2-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-warranty": "This software is distributed without any warranty.",
    "unlicense-head": "This is free and unencumbered software released into the public domain.",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0.",
    "bsd-endorse-2": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-3": "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl2-only-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl2-only-redistribute-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl3-only-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

#: The ordered rules; the first that fits at a place wins and takes its sentences with it.
RULES = (
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is")),
    ("Apache-2.0", ("apache-head", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-head", "apache-copy")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-warranty", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-2")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-3")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-2.0-only", ("gpl2-only-redistribute",)),
    ("GPL-2.0-only", ("gpl2-only-redistribute-2",)),
    ("GPL-3.0-only", ("gpl3-only-redistribute",)),
    ("GPL-2.0-or-later", ("gpl2-redistribute",)),
    ("LGPL-2.1-or-later", ("lgpl21-redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute",)),
    ("AGPL-3.0-or-later", ("agpl3-redistribute",)),
    ("MPL-2.0", ("mpl2-head", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-head", "mpl2-copy-2")),
    ("MPL-2.0", ("mpl2-head",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("CC0-1.0", ("cc0-dedicated", "cc0-warranty")),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("Unlicense", ("unlicense-head", "unlicense-grant")),
    ("Unlicense", ("unlicense-head",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("bsl-notice",)),
    ("ISC", ("isc-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-head",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("ccbync-notice",)),
    ("CC-BY-4.0", ("ccby-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa-notice",)),
)
#: Names by which licences are called.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "MIT-0": ("MIT No Attribution License", "MIT No Attribution"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPL version 2 only", "GPLv2", "GPL-2.0"),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later", "GPLv2 or later", "GPLv2+"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GPL-3.0"),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later", "GPLv3 or later", "GPLv3+"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL 2.1"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "LGPLv3", "LGPL 3.0"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "AGPLv3", "AGPL 3.0"),
    "CC0-1.0": ("CC0 1.0", "CC0", "Creative Commons Zero"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "CC BY 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"),
    "Unlicense": ("Unlicense",),
}
#: Phrases that put a text under a licence.
PHRASES = ("licensed under {}", "licensed under the {}", "licensed under a {}", "licensed under the terms of the {}", "released under {}", "released under the {}", "distributed under the {}", "available under the {}", "license: {}", "licence: {}")
#: Identifiers of tags beyond those of rules and names.
MORE_TAGS = ("LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "GPL-2.0-only", "GPL-3.0-only", "0BSD", "Artistic-2.0", "EUPL-1.2", "OFL-1.1", "PostgreSQL", "Python-2.0", "WTFPL")

_IDS = tuple(dict.fromkeys([*(licence for licence, _ in RULES), *NAMES, *MORE_TAGS]))
_NAMED = {f"named-{licence}-{i}-{j}": phrase.format(name) for licence, names in NAMES.items() for i, name in enumerate(names) for j, phrase in enumerate(PHRASES)}
_TAGS = {f"tag-{licence}": f"SPDX-License-Identifier: {licence}" for licence in _IDS}
SENTENCES |= _TAGS | _NAMED
RULES += tuple((licence, (f"tag-{licence}",)) for licence in _IDS)
RULES += tuple((licence, (f"named-{licence}-{i}-{j}",)) for licence, names in NAMES.items() for i in range(len(names)) for j in range(len(PHRASES)))

GAP = 9  # pieces of text, sentences or lines, without an identifier that may stand between two of a rule
SLOT = 12  # words that a slot stands for at most

_END = re.compile(r"(?<=[.!?:;])\s+|\n")
_PUNCT = re.compile(r"[^a-z0-9+]+")
_LIST_MARK = re.compile(r"^\s*(?:\(?(?:\d{1,2}|[A-Za-z])[.)]|[*+-])\s+")
#: A text in which none of these occurs cannot hold a known sentence.
MARKS = ("licen", "permi", "warrant", "distribut", "liab", "unencumbered", "anyone", "mozilla", "endorse", "released", "available", "dedicated")


def is_marked(text: str) -> bool:
    low = text.lower()
    return any(mark in low for mark in MARKS)


def normalise(sentence: str) -> str:
    """Lower-case ASCII letters, digits and plus signs, single blanks, no list marks at the front."""
    return _PUNCT.sub(" ", _LIST_MARK.sub("", sentence).lower()).strip()


Pieces = tuple[tuple[str, ...], ...]


def pieces(template: str) -> Pieces:
    """The words between the slots of a template."""
    return tuple(tuple(normalise(part).split()) for part in template.split("{}"))


_KNOWN: dict[tuple[str, str], list[tuple[str, Pieces]]] = {}
for _name, _text in SENTENCES.items():
    if not is_marked(_text):
        raise ValueError(f"{_name} has no marking word")
    _cut = pieces(_text)
    _KNOWN.setdefault(_cut[0][:2], []).append((_name, _cut))
_ID_WORDS = {tuple(normalise(licence).split()): licence for licence in _IDS}
_LONGEST_ID = max(map(len, _ID_WORDS))
_DENIED = ("not", "t")  # "is not licensed", "isn't licensed"


def is_phrase(name: str) -> bool:
    """Whether a sentence only names its licence."""
    return name.startswith("named-") or "-notice" in name


def fits(words: list[str], at: int, cut: Pieces) -> int:
    """Where a template that begins at a word ends, or 0: each slot is as short as can be."""
    end = at
    for i, piece in enumerate(cut):
        n = len(piece)
        if i == 0:
            start = at if tuple(words[at : at + n]) == piece else -1
        else:
            start = next((k for k in range(end + 1, end + 1 + SLOT) if tuple(words[k : k + n]) == piece), -1)
        if start < 0:
            return 0
        end = start + n
    return end


def _identifier(words: list[str], at: int) -> tuple[str, int] | None:
    """The longest licence identifier that begins at a word, and its end."""
    for n in range(_LONGEST_ID, 0, -1):
        licence = _ID_WORDS.get(tuple(words[at : at + n]))
        if licence and at + n <= len(words):
            return licence, at + n
    return None


def identify(text: str) -> list[tuple[int, int, str]]:
    """(first segment, last segment + 1, identifier) of the known sentences of a text, in order; a segment is a sentence or
    a line of one, so sentences may be wrapped. At each word the longest sentence counts, and the search goes on behind
    it; a tag's further identifiers, after "or" and "and", are tags of their own."""
    if not is_marked(text):
        return []
    words: list[str] = []
    segment: list[int] = []
    for k, part in enumerate(s for s in map(normalise, _END.split(text)) if s):
        more = part.split()
        words += more
        segment += [k] * len(more)
    found, i = [], 0
    while i < len(words):
        best, end = "", 0
        for name, cut in _KNOWN.get((words[i], words[i + 1] if i + 1 < len(words) else ""), ()):
            stop = fits(words, i, cut)
            if stop > end:
                best, end = name, stop
        if not end or (i and words[i - 1] in _DENIED and is_phrase(best)):
            i += 1
            continue
        found.append((segment[i], segment[end - 1] + 1, best))
        while best.startswith("tag-") and end < len(words) and words[end] in ("or", "and") and segment[end] == segment[end - 1]:
            more_ = _identifier(words, end + 1)
            if not more_:
                break
            found.append((segment[end], segment[end] + 1, f"tag-{more_[0]}"))
            end = more_[1]
        i = end
    return found


def match(found: list[tuple[int, int, str]], rules=RULES, gap: int = GAP) -> list[tuple[str, int]]:
    """(licence, number of its first segment): at each sentence that no licence has yet, the first rule whose sentences
    follow in order, with no more than ``gap`` unknown segments between two of them.

    Sentences of other licences may stand in between; they do not count, and are left for their own rules."""
    out, free, unknown, known = [], [True] * len(found), [], 0
    for first, stop, _ in found:
        unknown.append(first - known)  # unknown segments before this sentence
        known += stop - first
    for i in range(len(found)):
        if not free[i]:
            continue
        for licence, wanted in rules:
            at: list[int] = []
            for want in wanted:
                k = at[-1] + 1 if at else i
                last = len(found) if at else i + 1
                while k < last and not (free[k] and found[k][2] == want) and (not at or unknown[k] - unknown[at[-1]] <= gap):
                    k += 1
                if k >= last or found[k][2] != want or (at and unknown[k] - unknown[at[-1]] > gap):
                    break
                at.append(k)
            if len(at) == len(wanted):
                out.append((licence, found[i][0]))
                for k in at:
                    free[k] = False
                break
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, ``sentences`` (identifiers in order), ``matches`` (licences in order),
    ``licenses`` (distinct, sorted, comma-joined) and ``n_matches``.

    Null and empty texts hold none; repeated rows and null ids give a row each; other columns are ignored; an empty
    table gives an empty result. Of sentences that begin at one word the longest counts, and of equally long ones the
    first listed. Whole texts, very long ones too, are read one at a time, in one pass without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, rules = [], []
        for text in batch.column(1):
            found = identify(text.as_py() or "")
            names.append([name for _, _, name in found])
            rules.append([licence for licence, _ in match(found)])
        yield R.record(
            id=batch.column(0), sentences=pa.array(names, pa.list_(pa.string())), matches=pa.array(rules, pa.list_(pa.string())),
            licenses=pa.array([",".join(sorted(set(r))) for r in rules], pa.string()), n_matches=pa.array([len(r) for r in rules], pa.int64()),
        )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return R.map_arrow(rows, run, f"id {kind}, sentences array<string>, matches array<string>, licenses string, n_matches long").withColumnRenamed("id", id_col)
