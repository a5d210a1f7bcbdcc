"""License scans by conditional compression.

Blocks of a text around words that license texts use are held against templates.  Those of which nearly all words are there are
candidates (no other could be confirmed); each is the zstandard raw dictionary by which the block's words are compressed, and
candidates are ranked by the part of the size that this saves.  In that order each is held against its exact wording: its words are
aligned with the block's, and at most a small part of them may be missing, added or different (none in a short notice).  The first
that is confirmed names the license of that stretch; its words are taken out of the block and the rest is ranked again, until no
candidate is confirmed.  So of templates that fit the same words (versions of one license, a short notice within a long one) the
one that explains most of them wins.  ``scan`` without ``named`` reports every template within the limit.

Edge cases: a null or blank text, or one without such words, has no license; overlapping blocks are merged; several licenses in
one text are all reported, in alphabetical order; ties in rank go to the template that comes first; an empty table gives an
empty result; other columns are kept (``licenses`` replaces a column of that name).
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD3 = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_GNU = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; "
    "either version {2} of the License, or (at your option) any later version."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions"
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
    "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
    "Software, and to permit third-parties to whom the Software is furnished to do so"
)
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
_CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
#: Names of licenses in identifier lines.
_SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib",
)
#: Fixed values: (license, wording).  The long texts are the public license texts, the short ones common notices and titles.
TEMPLATES = [
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("BSD-3-Clause", _BSD + _BSD3),
    ("BSD-2-Clause", _BSD),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", _GNU.format("program", "General Public License", 2)),
    ("LGPL-2.1", _GNU.format("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("library", "Lesser General Public License", 3)),
    ("AGPL-3.0", _GNU.format("program", "Affero General Public License", 3)),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", _EPL),
    ("CC0-1.0", _CC0),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("Zlib", "Released under the zlib License."),
    ("ISC", "Released under the ISC License."),
    *((re.sub("-(only|or-later)$", "", x), f"SPDX-License-Identifier: {x}") for x in _SPDX),
]
_MARKS = ("licens", "copyright", "permission", "redistribut", "public domain", "warrant", "creative commons", "free software")
_MARK = re.compile("|".join(_MARKS))
#: Characters taken on both sides of a mark, how far on a line end is sought, and the most that one block holds (a longer stretch
#: becomes overlapping blocks).
REACH, LINE, MOST = 700, 200, 8000
#: The part of a template's words that may differ.
DIFFERING = 0.06
_WORD_PATTERN = re.compile(r"[^\W_]+(?:\.\d+)*")
_WORDS, _WORD_SPANS = _WORD_PATTERN.findall, _WORD_PATTERN.finditer


@lru_cache(maxsize=1)
def _compressors():
    import zstandard as z

    own = dict(level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    plain = z.ZstdCompressor(**own)
    return plain, [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(" ".join(_WORDS(t.lower())).encode(), dict_type=z.DICT_TYPE_RAWCONTENT), **own) for _, t in TEMPLATES]


@lru_cache(maxsize=1)
def _template_words() -> list[list[str]]:
    return [_WORDS(t.lower()) for _, t in TEMPLATES]


@lru_cache(maxsize=1)
def _template_counts() -> list[Counter]:
    return [Counter(w) for w in _template_words()]


def _most(k: int) -> int:
    return int(DIFFERING * len(_template_words()[k]))


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans around marks; a span is widened to the ends of its first and last line if they are near."""
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    if not any(m in low for m in _MARKS):
        return []
    spans: list[list[int]] = []
    for m in _MARK.finditer(low):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        a = text.rfind("\n", max(0, a - LINE), a) + 1 or a
        b = end if (end := text.find("\n", b, b + LINE)) >= 0 else b
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    out = []
    for a, b in spans:
        while b - a > MOST:
            out.append((a, a + MOST))
            a += MOST - 2 * REACH
        out.append((a, b))
    return out


def fit(want: list[str], have: list[str], most: int) -> tuple[list[str], int, int] | None:
    """Words missing (-) and added (+) where ``want`` fits best into a stretch of ``have``, and that stretch; None if more than ``most``."""
    n = len(have)
    row, back = [0] * (n + 1), []
    for i, w in enumerate(want, 1):
        new, step = [i] + [0] * n, [1] + [0] * n
        for j in range(1, n + 1):
            best, s = row[j - 1] + 2 * (have[j - 1] != w), 0
            if row[j] + 1 < best:
                best, s = row[j] + 1, 1
            if new[j - 1] + 1 < best:
                best, s = new[j - 1] + 1, 2
            new[j], step[j] = best, s
        row = new
        back.append(step)
        if min(row) > 2 * most:
            return None
    j = end = min(range(n + 1), key=row.__getitem__)
    i, diff = len(want), []
    while i:
        s = back[i - 1][j]
        if s == 0:
            if want[i - 1] != have[j - 1]:
                diff += [f"+{have[j - 1]}", f"-{want[i - 1]}"]
            i, j = i - 1, j - 1
        elif s == 1:
            diff.append(f"-{want[i - 1]}")
            i -= 1
        else:
            diff.append(f"+{have[j - 1]}")
            j -= 1
    diff.reverse()
    return (diff, j, end) if len(diff) <= most else None


def differences(want: list[str], have: list[str], most: int) -> list[str] | None:
    got = fit(want, have, most)
    return got and got[0] if got is not None else None


def _confirm(k: int, have: list[str]) -> tuple[list[str], list[tuple[int, int]]] | None:
    """Differing words and the stretches that a template stands for: the best one, or every exact one of a short notice."""
    want, most = _template_words()[k], _most(k)
    if most:
        got = fit(want, have, most)
        return got and (got[0], [got[1:]])
    n = len(want)
    found = [i for i in range(len(have) - n + 1) if have[i] == want[0] and have[i : i + n] == want]
    return ([], [(i, i + n) for i in found]) if found else None


def rank(text: str, templates: list[int]) -> list[tuple[float, int]]:
    """(part of the size that its dictionary saves, template) of a lower-case text, the largest saving first."""
    data = text.encode()
    plain, withs = _compressors()
    size = len(plain.compress(data))
    return sorted(((1 - len(withs[k].compress(data)) / size, k) for k in templates), key=lambda x: (-x[0], x[1]))


def name_block(block: str) -> list[tuple[str, int, float, list[str]]]:
    """(license, template, saved, differences): the first in rank whose wording is confirmed names its stretch; the words of that are
    taken out, and what is left is ranked again, until no template is confirmed."""
    low = block.lower()
    spans = [m.span() for m in _WORD_SPANS(low)]
    out = []
    while True:
        have = [low[a:b] for a, b in spans]
        held = Counter(have)
        near = [k for k, want in enumerate(_template_counts()) if (want - held).total() <= _most(k)]
        for saved, k in rank(" ".join(have), near) if near else ():
            got = _confirm(k, have)
            if got is not None:
                out.append((TEMPLATES[k][0], k, saved, got[0]))
                for a, b in reversed(got[1]):
                    low, spans = _without(low, spans, a, b)
                break
        else:
            return out


def _without(low: str, spans: list, a: int, b: int) -> tuple[str, list]:
    """What is left without words a to b - 1; a mark stands where they were, so that nothing joins over the gap."""
    mark = (len(low), len(low) + 1)
    return low + "\0", spans[:a] + [mark] + spans[b:]


def scan_block(block: str) -> list[tuple[str, int, float, list[str]]]:
    """(license, template, saved, differences) of the confirmed templates of a block, the best of each license."""
    have = _WORDS(block.lower())
    held = Counter(have)
    # each word that the block lacks is one that differs, so no other template can be confirmed
    near = [k for k, want in enumerate(_template_counts()) if (want - held).total() <= _most(k)]
    if not near:
        return []
    ranked = rank(" ".join(have), near)
    saved, confirmed = {k: x for x, k in ranked}, []
    for _, k in ranked:
        words, most = _template_words()[k], _most(k)
        diff = differences(words, have, most) if most else [] if _times(have, words) else None
        if diff is not None:
            confirmed.append((TEMPLATES[k][0], k, saved[k], diff))
    found: dict[str, tuple[str, int, float, list[str]]] = {}
    for x in confirmed:
        if not any(_covered(x, y, have) for y in confirmed) and (x[0] not in found or len(x[3]) < len(found[x[0]][3])):
            found[x[0]] = x
    return list(found.values())


def _covered(x, y, have: list[str]) -> bool:
    """Whether a longer wording of another license, which holds that of ``x`` as a part, stands for it wherever it occurs."""
    short, long = _template_words()[x[1]], _template_words()[y[1]]
    if x[0] == y[0] or len(short) >= len(long) or not (inside := _times(long, short)):
        return False
    return _most(x[1]) > 0 or _times(have, short) <= inside * _times(have, long)


def _times(have: list[str], words: list[str]) -> int:
    n = len(words)
    return sum(have[i] == words[0] and have[i : i + n] == words for i in range(len(have) - n + 1))


KIND = "array<struct<license: string, template: int, start: int, end: int, saved: double, differing: array<string>>>"


def name_text(text: str | None) -> list[dict]:
    """The licenses that ranking names, each with the block and template that differ least."""
    return scan_text(text, name_block)


def scan_text(text: str | None, of_block=None) -> list[dict]:
    """Every license whose wording a block holds within the limit, though another may fit the same words better (``name_text``: the best)."""
    best: dict[str, dict] = {}
    for a, b in blocks(text) if text else []:
        for name, k, saved, diff in (of_block or scan_block)(text[a:b]):
            if name not in best or len(diff) < len(best[name]["differing"]):
                best[name] = {"license": name, "template": k, "start": a, "end": b, "saved": round(saved, 4), "differing": diff}
    return [best[k] for k in sorted(best)]


def scan(df: DataFrame, text_col: str = "text", named: bool = False) -> DataFrame:
    """``df`` without its text, with ``licenses`` (KIND): what was found, where, and which words differ; ``named``: what ranking names."""
    import pyarrow as pa
    from pyspark.sql.types import StructType, _parse_datatype_string

    held = [c for c in df.columns if c not in (text_col, "licenses")]
    schema = StructType([df.schema[c] for c in held]).add("licenses", _parse_datatype_string(KIND))
    item = pa.struct([("license", pa.string()), ("template", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("saved", pa.float64()), ("differing", pa.list_(pa.string()))])

    def op(batches):
        for batch in C.sliced(batches):
            found = [(name_text if named else scan_text)(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*[batch.column(k) for k in range(batch.num_columns - 1)], pa.array(found, pa.list_(item))], names=[*held, "licenses"])

    return df.select(*held, F.col(text_col).cast("string").alias("__wl_in")).mapInArrow(op, schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.read_table(spark, sf_dir, "documents").select("doc_id", "text"), named=True)
    part = lambda f: F.array_join(F.transform("licenses", f), ",")
    return found.select(
        "doc_id", part(lambda x: x["license"]).alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"),
        part(lambda x: x["saved"].cast("string")).alias("saved"), F.coalesce(F.aggregate("licenses", F.lit(0), lambda a, x: a + F.size(x["differing"])), F.lit(0)).cast("long").alias("n_differing"),
    )
