"""Operator 8, licence recognition by sentence rules.

A text is cut into sentences; each is normalised (lower case, letters and digits, single spaces) and looked up among known licence
sentences; a sentence that line breaks cut is put together from its pieces. The sequence of identifiers found is matched against
ordered rules: a rule matches where its identifiers occur in order, with at most GAP unknown pieces between two. A rule whose
place lies in a longer rule's match is left out.

Null and empty texts have no licence. Repeated rows are scanned alike. Equal licences of a text are named once, in order of their
first place; of two at one place the rule of more sentences goes first, then the earlier one in RULES. Texts of any length are read
whole, in time proportional to their length. Columns but doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

GAP = 3
# Sentences of public licences, and the ordered rules over them.
SENTENCES = {
    "mit-title": "MIT License",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-project": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-no-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "gpl-free": "This program is free software:",
    "lgpl-free": "This library is free software;",
    "gpl3-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl3-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl2-preamble": "The licenses for most software are designed to take away your freedom to share and change it.",
    "mpl2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl": "You just DO WHAT THE FUCK YOU WANT TO.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-licensed": "Licensed under CC0 1.0.",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "gfdl": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;",
    "reserved": "All rights reserved.",
}
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]), ("MIT", ["mit-grant", "mit-notice"]), ("MIT", ["mit-title", "mit-grant"]), ("MIT", ["mit-released"]), ("MIT", ["mit-licensed"]), ("MIT", ["mit-project"]),
    ("ISC", ["isc-grant", "isc-warranty"]), ("ISC", ["isc-grant"]), ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-no-endorse"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-no-endorse"]), ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-header", "apache-use", "apache-copy"]), ("Apache-2.0", ["apache-title", "apache-terms"]), ("Apache-2.0", ["apache-grant"]), ("Apache-2.0", ["apache-licensed"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]), ("GPL-3.0-only", ["gpl-free", "gpl3-only"]), ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms"]), ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl21-terms"]), ("LGPL-3.0-or-later", ["gpl-free", "lgpl3-terms"]), ("GPL-3.0", ["gpl3-preamble"]), ("GPL-2.0", ["gpl2-preamble"]),
    ("MPL-2.0", ["mpl2-header", "mpl2-copy"]), ("MPL-2.0", ["mpl2-header"]), ("EPL-2.0", ["epl2-header"]), ("BSL-1.0", ["bsl-grant"]), ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("Unlicense", ["unlicense", "unlicense-anyone"]), ("Unlicense", ["unlicense"]), ("WTFPL", ["wtfpl-title", "wtfpl"]), ("CC0-1.0", ["cc0"]), ("CC0-1.0", ["cc0-licensed"]), ("OFL-1.1", ["ofl"]), ("GFDL-1.3-or-later", ["gfdl"]),
]
CUT = re.compile(r"\n|(?<=[.;:!?])\s+")
HINT = re.compile(r"licen[cs]e|permission|redistribut|free software|copyright|software|rights|spdx|distribut|conditions|materials|want to|public domain|anyone is|mpl was")


@lru_cache(maxsize=1)
def tables() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Normalised sentence -> identifier, and the rules; Creative Commons variants, GNU and SPDX lines follow from their parts."""
    known, rules = dict(SENTENCES), list(RULES)

    def add(name: str, *sentences: str) -> None:
        for i, s in enumerate(sentences):
            known[f"{name.lower()}~{i}"] = s
            rules.append((name, [f"{name.lower()}~{i}"]))

    words = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        long = "-".join(words[x] for x in kind.split("-"))
        for version, port in (("4.0", "International"), ("3.0", "Unported")):
            add(f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}.", f"This work is licensed under a Creative Commons {long} {version} {port} License.", f"This work is licensed under the Creative Commons {long} {version} {port} License.", f"This work is licensed under CC {kind} {version}.")
    for short, name, versions in (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",))):
        for v in versions:
            full = v if "." in v else v + ".0"
            add(f"{short}-{full}", f"This work is licensed under the {name}, version {v}.", f"Licensed under the {name}, version {v}.", f"Released under the {name}, version {v}.")
    for name in sorted({n for n, _ in rules}):
        known[f"spdx~{name.lower()}"] = f"SPDX-License-Identifier: {name}"
        rules.append((name, [f"spdx~{name.lower()}"]))
    return {normalise(s): k for k, s in known.items()}, rules


def normalise(sentence: str) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", sentence.lower()))


def identifiers(text: str, known: dict[str, str] | None = None) -> list[tuple[int, int, str]]:
    """(first piece, last piece, identifier) of the known sentences, in order. Pieces are joined as long as they begin a known sentence; the longest sentence wins."""
    if not HINT.search(text.lower()):  # every known sentence has such a word
        return []
    known = tables()[0] if known is None else known
    heads = beginnings(tuple(known))
    pieces = [s for s in map(normalise, CUT.split(text)) if s]
    out = []
    for i, joined in enumerate(pieces):
        j, found = i, None
        while joined in heads:
            if joined in known:
                found = (i, j, known[joined])
            j += 1
            if j == len(pieces):
                break
            joined += " " + pieces[j]
        if found:
            out.append(found)
    return out


@lru_cache(maxsize=4)
def beginnings(known: tuple[str, ...]) -> set[str]:
    """Every beginning of whole words of the known sentences."""
    return {" ".join(words[: n + 1]) for k in known for words in (k.split(" "),) for n in range(len(words))}


def matched(found: list[tuple[int, int, str]], rule: list[str], at: int) -> list[int] | None:
    """Places in ``found``, from ``at`` on, of the rule's identifiers in order, with at most GAP pieces between the end of one and the next; the first last place and the first places before it, or None."""
    steps: list[dict[int, int]] = [{at: -1}]
    for want in rule[1:]:
        now: dict[int, int] = {}
        for k in sorted(steps[-1]):
            for n in range(k + 1, len(found)):
                between = found[n][0] - found[k][1] - 1
                if between > GAP:
                    break
                if between >= 0 and found[n][2] == want:
                    now.setdefault(n, k)
        if not now:
            return None
        steps.append(now)
    out = [min(steps[-1])]
    for step in reversed(steps[1:]):
        out.append(step[out[-1]])
    return out[::-1]


def licences(found: list[tuple[int, int, str]], rules: list[tuple[str, list[str]]] | None = None) -> list[str]:
    """Names of the rules that match; a sentence serves the longest rule that has it."""
    rules = tables()[1] if rules is None else rules
    places: dict[str, list[int]] = {}
    for at, (_, _, k) in enumerate(found):
        places.setdefault(k, []).append(at)
    out, taken = [], set()
    for order, (name, rule) in sorted(enumerate(rules), key=lambda r: (-len(r[1][1]), r[0])):
        for at in places.get(rule[0], ()) if all(k in places for k in rule) else ():
            used = matched(found, rule, at) if at not in taken else None
            if used is not None and not taken.intersection(used):
                out.append((found[at][0], -len(rule), order, name))
                taken.update(used)
    return list(dict.fromkeys(n for *_, n in sorted(out)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, sentence_ids, licences, n_licences."""

    def run(batches):
        for b in batches:
            found = [identifiers(t or "") for t in b.column(1).to_pylist()]
            names = [licences(f) if f else [] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[k for *_, k in f] for f in found], pa.list_(pa.string())), pa.array(names, pa.list_(pa.string())), pa.array(map(len, names), pa.int64())], names=["doc_id", "sentence_ids", "licences", "n_licences"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, sentence_ids array<string>, licences array<string>, n_licences long")


def op8(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
