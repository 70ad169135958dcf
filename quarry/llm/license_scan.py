"""Licence scans by sentence rules.

A text falls into fragments at line ends and after ``. ; : ! ?`` before white space.  Fragments are normalised
(lower case, words of letters and digits) and runs of them, so that wrapped lines come together again, are looked
up among the known licence sentences: each known sentence has an identifier.  The identifiers of a document, in
order, are matched against the rules, which are ordered sequences of identifiers: longer rules first, at most
``GAP`` other fragments between two sentences of a rule, no sentence used twice.  ``SPDX-License-Identifier: X`` is
a sentence for each licence of the expression X, and names it; unknown identifiers are given as written.

Only texts with a cue go to the scan: a lower-cased substring that every known sentence has one of (checked when
the module loads), found with a built-in function over the whole text.

Defined results: null and empty texts have no sentences and no licences; equal rows give equal results; very long
texts are scanned whole, fragment by fragment; other columns pass through, columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.textvec import parts

GAP = 2

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "apache-2.0-ref": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License 2.0",
                       "This project is licensed under the Apache License, Version 2.0",
                       "Licensed under the Apache License, Version 2.0 (the \"License\")",
                       "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\")"],
    "apache-2.0-comply": ["you may not use this file except in compliance with the License"],
    "apache-2.0-obtain": ["You may obtain a copy of the License at"],
    "apache-2.0-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is "
                         "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "mit-ref": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"],
    "mit-title": ["MIT License", "The MIT License (MIT)", "The MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                  "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
                  "permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions "
                   "of the Software"],
    "mit-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
                  "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "gpl-3.0-ref": ["This work is licensed under the GNU General Public License, version 3",
                    "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License v3"],
    "gpl-3.0-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                     "later version"],
    "gpl-2.0-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                     "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
                     "later version"],
    "gpl-no-warranty": [f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
                        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE" for work in ("program", "library")],
    "lgpl-2.1-free": [f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                      "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
                      "option) any later version" for work in ("program", "library")],
    "lgpl-3.0-free": [f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                      "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                      "option) any later version" for work in ("program", "library")],
    "agpl-3.0-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                      "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                      "option) any later version"],
    "lgpl-details": ["See the GNU Lesser General Public License for more details"],
    "agpl-details": ["See the GNU Affero General Public License for more details"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "cc-by-nc-4.0-ref": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0",
                         "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-4.0-ref": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0",
                      "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0-ref": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0",
                         "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                           "the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                   "disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                   "disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorsement": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                        "products derived from this software without specific prior written permission"],
    "mpl-2.0-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense-ref": ["This is free and unencumbered software released into the public domain"],
    "isc-title": ["ISC License", "The ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                  "granted, provided that the above copyright notice and this permission notice appear in all copies",
                  "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
                  "granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-as-is": [f"THE SOFTWARE IS PROVIDED \"AS IS\" AND {author} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
                  "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS" for author in ("THE AUTHOR", "ISC")],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
                   "alter it and redistribute it freely, subject to the following restrictions"],
    "bsl-1.0-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsl-1.0-ref": ["Distributed under the Boost Software License, Version 1.0",
                    "Use, modification and distribution are subject to the Boost Software License, Version 1.0"],
    "bsl-1.0-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
                      "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
                      "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
                      "to whom the Software is furnished to do so, all subject to the following"],
    "epl-2.0-ref": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
                    "which is available at https://www.eclipse.org/legal/epl-2.0/",
                    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 "
                    "which is available at http://www.eclipse.org/legal/epl-2.0",
                    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 "
                    "which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html"],
    "epl-1.0-ref": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
                    "which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "cc0-1.0-dedication": [f"To the extent possible under law, the {author} dedicated all copyright and related and neighboring rights "
                           "to this software to the public domain worldwide" for author in ("author(s) have", "author has")],
    "cc0-1.0-copy": ["You should have received a copy of the CC0 Public Domain Dedication along with this software"],
    "cc0-1.0-ref": ["Licensed under CC0 1.0", "CC0 1.0 Universal", "This work is licensed under CC0 1.0",
                    "This work is marked with CC0 1.0 Universal"],
    "all-rights-reserved": ["All rights reserved"],
}

# Ordered rules.  A sentence identifier followed by ? may be missing.
RULES = [
    ("MIT", ["mit-title?", "copyright-line?", "all-rights-reserved?", "mit-grant", "mit-notice", "mit-as-is?"]),
    ("BSD-3-Clause", ["copyright-line?", "all-rights-reserved?", "bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorsement"]),
    ("BSD-2-Clause", ["copyright-line?", "all-rights-reserved?", "bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["copyright-line?", "gpl-3.0-free", "gpl-no-warranty", "gpl-details?"]),
    ("GPL-2.0-or-later", ["copyright-line?", "gpl-2.0-free", "gpl-no-warranty", "gpl-details?"]),
    ("LGPL-2.1-or-later", ["copyright-line?", "lgpl-2.1-free", "gpl-no-warranty", "lgpl-details?"]),
    ("LGPL-3.0-or-later", ["copyright-line?", "lgpl-3.0-free", "gpl-no-warranty", "lgpl-details?"]),
    ("AGPL-3.0-or-later", ["copyright-line?", "agpl-3.0-free", "gpl-no-warranty", "agpl-details?"]),
    ("ISC", ["isc-title?", "copyright-line?", "all-rights-reserved?", "isc-grant", "isc-as-is?"]),
    ("ISC", ["isc-title", "copyright-line"]),
    ("Zlib", ["copyright-line?", "zlib-as-is", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["copyright-line?", "bsl-1.0-ref"]),
    ("BSL-1.0", ["bsl-1.0-title?", "bsl-1.0-grant"]),
    ("EPL-2.0", ["copyright-line?", "all-rights-reserved?", "epl-2.0-ref"]),
    ("EPL-1.0", ["copyright-line?", "all-rights-reserved?", "epl-1.0-ref"]),
    ("CC0-1.0", ["copyright-line?", "cc0-1.0-dedication", "cc0-1.0-copy?"]),
    ("CC0-1.0", ["cc0-1.0-copy"]),
    ("CC0-1.0", ["cc0-1.0-ref"]),
    ("Apache-2.0", ["copyright-line?", "apache-2.0-ref", "apache-2.0-comply", "apache-2.0-obtain?", "apache-2.0-as-is?"]),
    ("Apache-2.0", ["apache-2.0-ref"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-title", "copyright-line"]),
    ("GPL-3.0", ["gpl-3.0-ref"]),
    ("GPL-3.0-or-later", ["gpl-3.0-free"]),
    ("GPL-2.0-or-later", ["gpl-2.0-free"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-free"]),
    ("LGPL-3.0-or-later", ["lgpl-3.0-free"]),
    ("AGPL-3.0-or-later", ["agpl-3.0-free"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-ref"]),
    ("CC-BY-4.0", ["cc-by-4.0-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-ref"]),
    ("MPL-2.0", ["mpl-2.0-ref"]),
    ("Unlicense", ["unlicense-ref"]),
    ("All-Rights-Reserved", ["copyright-line?", "all-rights-reserved"]),
]

# Every known sentence, in lower case, holds one of these.
CUES = ("licen", "copyright", "rights reserved", "permission", "redistribut", "warrant", "public domain", "cc0", "spdx")

_WORD = re.compile(r"[a-z0-9]+")
_END = re.compile(r"(?<=[.;:!?])\s+")
# a licence expression: identifiers joined by AND, OR and WITH, in brackets or not
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[ \t]*[a-z0-9][a-z0-9.+:-]*[ \t]*\)*"
                   r"(?:[ \t]*\b(?:AND|OR|WITH)\b[ \t]*\(*[ \t]*[a-z0-9][a-z0-9.+:-]*[ \t]*\)*)*)", re.I)
_TOKEN = re.compile(r"[a-z0-9][a-z0-9.+:-]*", re.I)
SPDX = "spdx-license-identifier"            # no word of a text has a hyphen


def words_of(sentence: str) -> tuple[str, ...]:
    return tuple("license" if w == "licence" else "licensed" if w == "licenced" else w for w in _WORD.findall(sentence.lower()))


def spdx_ids(expression: str) -> tuple[str, ...]:
    """Licence identifiers of an SPDX expression, in order; what WITH names is an exception and no licence."""
    tokens = _TOKEN.findall(expression)
    ids = [t.removesuffix("--") for i, t in enumerate(tokens)
           if t.upper() not in ("AND", "OR", "WITH") and (i == 0 or tokens[i - 1].upper() != "WITH")]
    return tuple(SPDX_CASE.get(t.lower(), t) for t in ids)


KNOWN = {words_of(s): name for name, group in SENTENCES.items() for s in group}
# a sentence with inner terminators is met fragment by fragment: all starts are kept
STARTS: dict[str, int] = {}
for _words in KNOWN:
    STARTS[_words[0]] = max(STARTS.get(_words[0], 0), len(_words))
SPDX_CASE = {name.lower(): name for name, _rule in RULES}         # identifiers are equal without regard to case
assert all(any(c in s.lower() for c in CUES) for group in SENTENCES.values() for s in group), "a sentence without a cue"

RESULT = [T.StructField("n_sentences", T.LongType()), T.StructField("licenses", T.ArrayType(T.StringType())),
          T.StructField("matches", T.ArrayType(T.StructType([
              T.StructField("license", T.StringType()), T.StructField("sentences", T.ArrayType(T.StringType())),
              T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))]


def fragments(text: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, stop, normalised words) of each fragment that has words."""
    out, at = [], 0
    for line in text.split("\n"):
        begin = 0
        tag = _SPDX.search(line)
        if tag:
            if words := words_of(line[:tag.start()]):
                out.append((at, at + tag.start(), words))
            out.append((at + tag.start(), at + tag.start(1) + len(tag[1].rstrip()), (SPDX, *spdx_ids(tag[1]))))
            begin = tag.end()
        for cut in [*_END.finditer(line, begin), None]:
            stop = cut.start() if cut else len(line)
            words = words_of(line[begin:stop])
            if words:
                out.append((at + begin, at + stop, words))
            begin = cut.end() if cut else stop
        at += len(line) + 1
    return out


def sentences(frags: list) -> list[tuple[str, int, int]]:
    """(identifier, first fragment, last fragment) of the known sentences, in order, the longest at each place."""
    out, i = [], 0
    while i < len(frags):
        best = None
        head = frags[i][2]
        if head[0] == SPDX:
            out += [(f"spdx:{name}", i, i) for name in head[1:]]
            i += 1
            continue
        if head[0] == "copyright" and len(head) > 1 and (head[1] == "c" or head[1].isdigit()):
            best = ("copyright-line", i, i)
        most = STARTS.get(head[0], 0)
        words: tuple[str, ...] = ()
        for j in range(i, len(frags) if most else i):
            words += frags[j][2]
            if len(words) > most:
                break
            if words in KNOWN:
                best = (KNOWN[words], i, j)
        if best:
            out.append(best)
        i = best[2] + 1 if best else i + 1
    return out


def _fits(rule: list[str], found: list, at: int) -> int:
    """How many found sentences from ``at`` on the rule takes; 0 if it does not match."""
    i = at
    for item in rule:
        name, optional = item.rstrip("?"), item.endswith("?")
        close = i == at or i < len(found) and found[i][1] - found[i - 1][2] - 1 <= GAP
        if i < len(found) and found[i][0] == name and close:
            i += 1
        elif not optional:
            return 0
    return i - at


def matches(found: list) -> list[tuple[str, int, int]]:
    """(licence, from, to) over the found sentences: the rule that takes most sentences, earlier rules first."""
    out, at = [], 0
    while at < len(found):
        if found[at][0].startswith("spdx:"):
            out.append((found[at][0].removeprefix("spdx:"), at, at + 1))
            at += 1
            continue
        n, name = max(((_fits(rule, found, at), -no, name) for no, (name, rule) in enumerate(RULES)), key=lambda x: x[:2])[::2]
        if n:
            out.append((name, at, at + n))
        at += max(1, n)
    return out


def scan_text(text: str) -> tuple[int, list[str], list[dict]]:
    frags = fragments(text)
    found = sentences(frags)
    got = [{"license": name, "sentences": [s[0] for s in found[a:b]], "start": frags[found[a][1]][0], "stop": frags[found[b - 1][2]][1]}
           for name, a, b in matches(found)]
    return len(found), sorted({m["license"] for m in got}), got


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (with text) and n_sentences (known ones), licenses (sorted, distinct) and matches (with character spans)."""
    docs = docs.drop(*[f.name for f in RESULT], "_ls_text")
    lowered = F.lower("text")
    cue = F.lit(False)
    for c in CUES:
        cue = cue | lowered.contains(c)
    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([
        ("license", pa.string()), ("sentences", pa.list_(pa.string())), ("start", pa.int64()), ("stop", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            got = [scan_text(t.as_py()) if t.is_valid else (0, [], []) for t in batch.column("_ls_text")]
            keep = [n for n in batch.schema.names if n != "_ls_text"]
            yield pa.record_batch([batch.column(n) for n in keep] + [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)],
                                  names=keep + [f.name for f in RESULT])
    return docs.withColumn("_ls_text", F.when(cue, F.col("text"))).mapInArrow(run, T.StructType([*docs.schema.fields, *RESULT]))
