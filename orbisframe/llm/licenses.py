"""License scans by sentence rules.

A text is split into sentences, each is normalised (lower case, punctuation
and white space reduced to single blanks) and mapped to the identifier of a
known licence sentence. The sequence of identifiers is matched against
ordered rules: a rule names the sentences that must follow one another, with
sentences that nobody knows between them skipped up to a gap. Longer rules go
first and their sentences aren't used again.

A part that ends with a semicolon or an abbreviation's full stop may go on; it
is read with the next parts first, so a sentence is found whole. Sentences that
put something under a licence by its name are known for all names that
``license_names`` builds.

Defined results: null and empty texts have no licence. A licence that stands
several times is counted and listed each time, in order of its place. Every
sentence of the whole text is looked at; texts without any of the words of
which each known sentence contains one are settled by one search over the
batch. Every row gives a row, also repeated ones and those with a null doc_id;
an empty table gives none. Only doc_id and text are read, so further columns
don't matter. The work grows with a text's length, also where one sentence
stands thousands of times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Sentences of public licences, as patterns over normalised text
# (lower case, only letters, digits and single blanks).
SENTENCES: dict[str, str] = {
    "MitGrant": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*",
    "MitNotice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "ZlibAsIs": r"this software is provided as is without any express or implied warranty",
    "ZlibGrant": r"permission is granted to anyone to use this software for any purpose including commercial applications.*",
    "BoostGrant": r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*",
    "UnlicenseRelease": r"this is free and unencumbered software released into the public domain",
    "UnlicenseAnyone": r"anyone is free to copy modify publish use compile sell or distribute this software.*",
    "AsIs": r"(?:the|this) software is provided (?:by the copyright holders and contributors )?as is.*warrant.*",
    "NoLiability": r"in no event shall the (?:authors|copyright).*liable.*",
    "BsdGrant": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*",
    "BsdSource": r"(?:\d )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": r"(?:\d )?redistributions in binary form must reproduce the above copyright notice.*",
    "BsdNames": r"(?:\d )?neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission",
    "IscGrant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*",
    "ApacheGrant": r"licensed under the apache license version 2 0(?: the license)?",
    "ApacheComply": r"you may not use this file except in compliance with the license",
    "ApacheCopy": r"you may obtain a copy of the license at.*",
    "ApacheAsIs": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*",
    "MitRef": r"(?:this .* is )?(?:released|licensed|distributed|available) under (?:the terms of )?the mit license",
    "BsdRef": r"(?:this .* is )?(?:released|licensed|distributed|available) under (?:the terms of )?(?:the|a) bsd(?: style)? license",
    "ApacheRef": r"this .* is (?:released|licensed|distributed) under the apache license version 2 0",
    "Gpl3Ref": r"(?:this .* is )?licensed under the gnu general public license version 3(?: or .*)?",
    "Gpl2Ref": r"(?:this .* is )?licensed under the gnu general public license version 2(?: or .*)?",
    "Lgpl3Ref": r"(?:this .* is )?licensed under the gnu lesser general public license version 3(?: or .*)?",
    "Lgpl21Ref": r"(?:this .* is )?licensed under the gnu lesser general public license version 2 1(?: or .*)?",
    "Agpl3Ref": r"(?:this .* is )?licensed under the gnu affero general public license version 3(?: or .*)?",
    "Gpl3Free": r"(?:.* is free software )?you (?:can|may) redistribute it and or modify it under the terms of (?:the gnu general public license .*version 3(?: .*)?|version 3 (?:only )?of the gnu general public license.*)",
    "Gpl2Free": r"(?:.* is free software )?you (?:can|may) redistribute it and or modify it under the terms of (?:the gnu general public license .*version 2(?: .*)?|version 2 (?:only )?of the gnu general public license.*)",
    "Lgpl3Free": r"(?:.* is free software )?you (?:can|may) redistribute it and or modify it under the terms of (?:the gnu lesser general public license .*version 3(?: .*)?|version 3 (?:only )?of the gnu lesser general public license.*)",
    "Lgpl21Free": r"(?:.* is free software )?you (?:can|may) redistribute it and or modify it under the terms of (?:the gnu lesser general public license .*version 2 1(?: .*)?|version 2 1 (?:only )?of the gnu lesser general public license.*)",
    "Agpl3Free": r"(?:.* is free software )?you (?:can|may) redistribute it and or modify it under the terms of (?:the gnu affero general public license .*version 3(?: .*)?|version 3 (?:only )?of the gnu affero general public license.*)",
    "GplHope": r".* is distributed in the hope that it will be useful but without any warranty.*",
    "GplSee": r"see the gnu (?:lesser |affero )?general public license for more details",
    "GplCopy": r"you should have received a copy of the gnu (?:lesser |affero )?general public license along with .*",
    "EplRef": r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version |v )?2 0.*",
    "ArtisticRef": r"(?:this .* is )?(?:released|licensed|distributed) under (?:the terms of )?the artistic license (?:version )?2 0",
    "OflRef": r"this font software is licensed under the sil open font license version 1 1.*",
    "MplRef": r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0",
    "MplCopy": r"if a copy of the mpl was not distributed with this file you can obtain one at .*",
    "CcByNc4": r"(?:this .* is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:cc by nc 4 0|creative commons attribution non ?commercial 4 0(?: international)?)(?: license)?",
    "CcByNcSa4": r"(?:this .* is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:cc by nc sa 4 0|creative commons attribution non ?commercial share ?alike 4 0(?: international)?)(?: license)?",
    "CcByNcNd4": r"(?:this .* is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:cc by nc nd 4 0|creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?)(?: license)?",
    "CcByNd4": r"(?:this .* is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:cc by nd 4 0|creative commons attribution no ?derivatives 4 0(?: international)?)(?: license)?",
    "CcBySa4": r"(?:this .* is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:cc by sa 4 0|creative commons attribution share ?alike 4 0(?: international)?)(?: license)?",
    "CcBy4": r"(?:this .* is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:cc by 4 0|creative commons attribution 4 0(?: international)?)(?: license)?",
    "Cc0": r"(?:this .* is )?(?:released|licensed|dedicated|distributed|available) (?:to|under) (?:the public domain under )?(?:cc0|cc0 1 0)(?: license)?",
    "Spdx": r"(?:.* )?spdx license identifier [a-z0-9 ]+",
    "Copyright": r"copyright (?:c )?\d{4}.*",
    "AllRights": r"all rights reserved",
}

# Ordered rules, sequences of sentence identifiers.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames", "AsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "AsIs")),
    ("MIT", ("MitGrant", "MitNotice", "AsIs")),
    ("Apache-2.0", ("ApacheGrant", "ApacheComply", "ApacheCopy", "ApacheAsIs")),
    ("GPL-3.0", ("Gpl3Free", "GplHope", "GplSee", "GplCopy")),
    ("GPL-2.0", ("Gpl2Free", "GplHope", "GplSee", "GplCopy")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("GPL-3.0", ("Gpl3Free", "GplHope")),
    ("GPL-2.0", ("Gpl2Free", "GplHope")),
    ("Zlib", ("ZlibAsIs", "ZlibGrant")),
    ("Unlicense", ("UnlicenseRelease", "UnlicenseAnyone")),
    ("ISC", ("IscGrant", "AsIs")),
    ("ISC", ("IscGrant",)),
    ("MIT", ("MitGrant",)),
    ("GPL-3.0", ("Gpl3Free",)),
    ("GPL-2.0", ("Gpl2Free",)),
    ("LGPL-3.0", ("Lgpl3Free",)),
    ("LGPL-2.1", ("Lgpl21Free",)),
    ("AGPL-3.0", ("Agpl3Free",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("Zlib", ("ZlibGrant",)),
    ("Unlicense", ("UnlicenseRelease",)),
    ("BSD", ("BsdGrant",)),
    ("Apache-2.0", ("ApacheGrant",)),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MitRef",)),
    ("BSD", ("BsdRef",)),
    ("GPL-3.0", ("Gpl3Ref",)),
    ("GPL-2.0", ("Gpl2Ref",)),
    ("LGPL-3.0", ("Lgpl3Ref",)),
    ("LGPL-2.1", ("Lgpl21Ref",)),
    ("AGPL-3.0", ("Agpl3Ref",)),
    ("EPL-2.0", ("EplRef",)),
    ("Artistic-2.0", ("ArtisticRef",)),
    ("OFL-1.1", ("OflRef",)),
    ("MPL-2.0", ("MplRef", "MplCopy")),
    ("MPL-2.0", ("MplRef",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa4",)),
    ("CC-BY-NC-ND-4.0", ("CcByNcNd4",)),
    ("CC-BY-ND-4.0", ("CcByNd4",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC0-1.0", ("Cc0",)),
    ("SPDX", ("Spdx",)),
]  # a sentence that names a licence is a rule of its own, see ``license_names``

#: Families of licences: abbreviation, name, versions. A licence is called by
#: either, with its version.
FAMILIES = (
    ("GPL", "gnu general public license", "2.0 3.0"), ("LGPL", "gnu lesser general public license", "2.1 3.0"), ("AGPL", "gnu affero general public license", "3.0"),
    ("GFDL", "gnu free documentation license", "1.2 1.3"), ("Apache", "apache license", "1.1 2.0"), ("MPL", "mozilla public license", "1.1 2.0"), ("EPL", "eclipse public license", "1.0 2.0"),
    ("EUPL", "european union public licen[cs]e", "1.1 1.2"), ("CDDL", "common development and distribution license", "1.0 1.1"), ("CPL", "common public license", "1.0"), ("AFL", "academic free license", "3.0"),
    ("OSL", "open software license", "3.0"), ("Artistic", "artistic license", "1.0 2.0"), ("BSL", "boost software license", "1.0"), ("OFL", "(?:sil )?open font license", "1.0 1.1"),
)
#: Licences without a version.
SINGLE = {
    "MIT": "(?:the )?(?:mit|expat|mit expat)", "ISC": "isc", "Zlib": "zlib(?: libpng)?", "Unlicense": "unlicense", "WTFPL": "wtfpl", "0BSD": "0bsd|zero clause bsd|bsd zero clause",
    "BSD-2-Clause": "bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd", "BSD-3-Clause": "bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd", "CC0-1.0": "cc0(?: 1 0)?(?: universal)?",
}
#: Parts of Creative Commons licences, and their versions.
COMMONS = {"BY": "attribution", "SA": "share ?alike", "ND": "no ?deriv(?:ative)?s?(?: works)?", "NC": "non ?commercial"}
COMMONS_KINDS, COMMONS_VERSIONS = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"), ("1.0", "2.0", "2.5", "3.0", "4.0")


def _versioned(version: str) -> str:
    major, minor = version.split(".")
    return f"{major}(?: 0)?" if minor == "0" else f"{major} {minor}"


def license_names() -> dict[str, str]:
    """Patterns of what each licence is called, by its identifier."""
    out = {}
    for short, long, versions in FAMILIES:
        for version in versions.split():
            v = _versioned(version)
            out[f"{short}-{version}"] = rf"(?:gnu )?{short.lower()}(?: license)?,? ?(?:v|version |v )?{v}|{long},? ?(?:v|version |v )?{v}|version {v} of the {long}".replace(",?", "")
    out |= SINGLE
    for kind in COMMONS_KINDS:
        parts = kind.split("-")
        for version in COMMONS_VERSIONS:
            out[f"CC-{kind}-{version}"] = rf"(?:cc {' '.join(parts).lower()}|(?:the )?creative commons {' '.join(COMMONS[x] for x in parts)}) (?:license )?{version.replace('.', ' ')}(?: (?:international|unported|generic))?"
    return out


NAMES = license_names()
_GROUPS = {f"n{k}": name for k, name in enumerate(NAMES)}
_NAME = re.compile("(?:the |an? )?(?:" + "|".join(f"(?P<{g}>{NAMES[n]})" for g, n in _GROUPS.items()) + r")(?: (?:public )?licen[sc]e)?(?: only| or (?:any )?(?:later|newer|above|at your option).*| as published by .*|\+)?")
_UNDER = re.compile(r"(?:^|.* )(?:licen[sc]ed|released|distributed|available|provided|published|covered|governed) (?:under|by)(?: the terms(?: and conditions)? of)? (.*)")
_LABEL = re.compile(r"(?:.*? )??licen[sc]e(?: is)? (.*)")

#: Every known sentence contains one of these.
_VERBS = ("released", "distributed", "available", "provided", "published", "covered", "governed")
KEYWORDS = tuple(f"{v} {u}" for v in _VERBS for u in ("under", "by"))
KEYWORDS += tuple(dict.fromkeys(x for f, _, vs in FAMILIES for v in vs.split() for x in (f"{f} {v[0]}".lower(), f"{f} v".lower(), f"{f}v".lower(), f"{f}{v[0]}".lower())))
KEYWORDS += ("bsd", "copy of the mpl", "licen", "copyright", "warrant", "permission", "redistribut", "reserved", "liable", "gnu", "spdx", "cc0", "cc by", "creative commons", "public domain", "free to copy")
#: The same in text that isn't normalised.
RAW_KEYWORDS = "(?i)" + "|".join(k.replace(" ", "[^a-z0-9]+") for k in KEYWORDS)
MAX_GAP = 3
RULES += [(name, (f"Named:{name}",)) for name in NAMES]

_SPLIT = re.compile(r"\n\s*\n|(?<=[.!?;])(?=\s)|\n(?=\s*(?:[-*#]|\d+[.)])\s)|(?<=[.!?;:])\n")
# what ends so may go on: a semicolon, or an abbreviation's full stop
_SOFT = re.compile(r"(?:;|\b(?:v|ver|vers|no|inc|ltd|co|corp)\.)\s*$", re.I)
#: Parts that a sentence is put together from at most.
PARTS = 4
_SPDX = re.compile(r"spdx-license-identifier:\s*([^\n*]*)", re.I)
_LINE = re.compile(r"\n")
_CLEAN = re.compile(r"[^a-z0-9]+")
_PATTERN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SENTENCES.items()))


def normalise(sentence: str) -> str:
    return _CLEAN.sub(" ", sentence.lower()).strip()


def sentences(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised) of each sentence: a part up to a full stop and
    white space. A line that is a known sentence by itself also counts, since
    licence lines often stand alone between texts without full stops."""
    pos = 0
    bounds = [m.end() if m.group() else m.start() for m in _SPLIT.finditer(text)] + [len(text)]
    for end in bounds:
        part = text[pos:end]
        if "\n" in part.strip():
            inner = [(pos + a, pos + b) for a, b in _lines(part)]
            if any(_known(normalise(text[a:b])) for a, b in inner):
                for a, b in inner:
                    yield a, b, normalise(text[a:b])
                pos = end
                continue
        if s := normalise(part):
            yield pos, end, s
        pos = end


def _lines(part: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _LINE.finditer(part):
        yield at, m.start()
        at = m.end()
    yield at, len(part)


def _known(sentence: str) -> str | None:
    """The identifier of a known sentence: by its pattern, or because it puts
    something under a licence by name."""
    if not any(k in sentence for k in KEYWORDS):
        return None
    m = _PATTERN.fullmatch(sentence)
    if m:
        return m.lastgroup
    for form in (_UNDER, _LABEL):
        if (m := form.fullmatch(sentence)) and (n := _NAME.fullmatch(m[1])):
            return f"Named:{_GROUPS[n.lastgroup]}"
    n = _NAME.fullmatch(sentence)
    if n and (re.search(r"licen[sc]e|\d", sentence)):
        return f"Named:{_GROUPS[n.lastgroup]}"
    return None


def known_sentences(text: str) -> list[tuple[int, int, int, str]]:
    """(number, start, end, identifier). A part that may go on is read
    together with the next ones first, the longest known reading counts."""
    parts = list(sentences(text))
    out, n = [], 0
    while n < len(parts):
        last = n
        while last + 1 < min(n + PARTS, len(parts)) and _SOFT.search(text[parts[last][0] : parts[last][1]]):
            last += 1
        for k in range(last, n - 1, -1):
            whole = parts[n][2] if k == n else " ".join(x[2] for x in parts[n : k + 1])
            if name := _known(whole):
                out.append((n, parts[n][0], parts[k][1], name))
                n = k
                break
        n += 1
    return out


def spdx_licenses(text: str) -> list[str]:
    """Licence identifiers of an SPDX line, exceptions left out."""
    m = _SPDX.search(text)
    words = re.findall(r"[A-Za-z0-9][A-Za-z0-9.+-]*", m[1]) if m else []
    return [w.rstrip(".") for k, w in enumerate(words) if w.upper() not in ("AND", "OR", "WITH") and (not k or words[k - 1].upper() != "WITH")]


def recognise(text: str | None) -> tuple[list[str], list[tuple[str, int, int]]]:
    """(sentence identifiers in order, licences as (name, start, end))."""
    if not text:
        return [], []
    found = known_sentences(text)
    out = []
    for name, chain in match_rules([(n, k) for n, _, _, k in found]):
        a, b = found[chain[0]][1], found[chain[-1]][2]
        out += [(x, a, b) for x in (spdx_licenses(text[a:b]) if name == "SPDX" else [name])]
    return [x[3] for x in found], sorted(out, key=lambda x: x[1:])


def match_rules(found: list[tuple[int, str]], rules: list[tuple[str, tuple[str, ...]]] = RULES) -> list[tuple[str, list[int]]]:
    """(rule's name, places in ``found``) of every match; ``found`` holds
    (sentence number, identifier) in order. Rules go in their order, each from
    left to right, and a place is used once."""
    places: dict[str, list[int]] = {}
    for i, (_, k) in enumerate(found):
        places.setdefault(k, []).append(i)
    used, out = set(), []
    for name, rule in rules:
        for i in places.get(rule[0], ()):
            if i in used:
                continue
            chain = [i]
            for want in rule[1:]:
                # sentences are numbered in order, so only a few places can be near enough
                top = found[chain[-1]][0] + MAX_GAP + 1
                j = chain[-1] + 1
                while j < len(found) and found[j][0] <= top and (found[j][1] != want or j in used):
                    j += 1
                if j == len(found) or found[j][0] > top:
                    break
                chain.append(j)
            if len(chain) == len(rule):
                used.update(chain)
                out.append((name, chain))
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, sentences, licenses, starts, ends, n_licenses.
    starts and ends are code points."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = pc.fill_null(pc.match_substring_regex(batch.column(1), RAW_KEYWORDS), False)
            got = [recognise(x.as_py()) if y else ([], []) for x, y in zip(batch.column(1), maybe.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([x[0] for x in got], pa.list_(pa.string())), pa.array([[y[0] for y in x[1]] for x in got], pa.list_(pa.string())),
                    pa.array([[y[1] for y in x[1]] for x in got], pa.list_(pa.int64())), pa.array([[y[2] for y in x[1]] for x in got], pa.list_(pa.int64())),
                    pa.array([len(x[1]) for x in got], pa.int64()),
                ],
                ["doc_id", "sentences", "licenses", "starts", "ends", "n_licenses"],
            )

    kinds = "doc_id long, sentences array<string>, licenses array<string>, starts array<long>, ends array<long>, n_licenses long"
    return docs.select("doc_id", "text").mapInArrow(work, kinds)
