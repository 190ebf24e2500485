"""License statements by ordered signature rules.

A text is read as its words (A-Z lowered; digits, letters and everything beyond
ASCII, all else separates) with single spaces between them, so that punctuation,
line breaks and comment marks never split a phrase. Several hundred regular
expressions run over that form: grants, titles, identifiers, addresses and
metadata fields of each license, written once as a form and combined with the
names of the license, and the wording of the common texts themselves.

A rule runs only where its topic and its keyword occur (plain substring
searches), so a text without any topic costs no regular expression. Rules are
ordered by priority; a detection whose interval of words lies within that of a
detection of the same or a higher priority is suppressed, which leaves
"lesser general public license version 2 1" and drops the "general public license"
inside it. Detections of the plain phrases (``BASE``) are never suppressed and
suppress nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlife.llm.common import mapped

# Phrases that count wherever their words stand, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licenses: label, keyword, names (regular expressions over words), identifiers as words. The more particular come first.
LICENSES = [
    ("agpl-3", "affero", r"(?:gnu )?affero (?:general )?public licen[sc]e(?: as published by the free software foundation)?(?: agpl)?(?: either)?(?: version| v)? ?v?3(?: 0)?", r"agpl (?:v ?)?3(?: 0)?(?: only| or later)?"),
    ("agpl", "affero", r"(?:gnu )?affero (?:general )?public licen[sc]e", r"agpl"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser (?:general )?public licen[sc]e(?: as published by the free software foundation)?(?: lgpl)?(?: either)?(?: version| v)? ?v?3(?: 0)?", r"lgpl (?:v ?)?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser (?:general )?public licen[sc]e(?: as published by the free software foundation)?(?: lgpl)?(?: either)?(?: version| v)? ?v?2 1", r"lgpl (?:v ?)?2 1(?: only| or later)?"),
    ("lgpl-2", "library", r"(?:gnu )?library (?:general )?public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?2(?: 0)?", r"lgpl (?:v ?)?2(?: 0)?(?: only| or later)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser (?:general )?public licen[sc]e", r"lgpl"),
    ("gpl-3", "general", r"(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: gpl)?(?: either)?(?: version| v)? ?v?3(?: 0)?", r"gpl (?:v ?)?3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "general", r"(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: gpl)?(?: either)?(?: version| v)? ?v?2(?: 0)?", r"gpl (?:v ?)?2(?: 0)?(?: only| or later)?"),
    ("gpl-1", "general", r"(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: gpl)?(?: either)?(?: version| v)? ?v?1(?: 0)?", r"gpl (?:v ?)?1(?: 0)?(?: only| or later)?"),
    ("gpl", "general", r"(?:gnu )?general public licen[sc]e", r"gnu gpl|gpl"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation licen[sc]e(?: version)? 1 3", r"gfdl 1 3(?: only| or later)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e", r"gfdl"),
    ("apache-2", "apache", r"apache(?: software)? licen[sc]e(?: version| v)? 2(?: 0)?|apache 2 0 licen[sc]e", r"apache (?:v ?)?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e(?: version| v)? 1 1", r"apache 1 1"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", r"apache"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[sc]e)?", r"mit 0"),
    ("mit", "mit", r"(?:mit|expat)(?: x11)?(?: open source)? licen[sc]e|mit style licen[sc]e", r"mit"),
    ("bsd-4-clause", "bsd", r"(?:original |old )bsd licen[sc]e|(?:4|four) clause bsd(?: licen[sc]e)?|bsd (?:4|four) clause(?: licen[sc]e)?", r"bsd 4 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised) bsd licen[sc]e|(?:3|three) clause bsd(?: licen[sc]e)?|bsd (?:3|three) clause(?: licen[sc]e)?", r"bsd 3 clause"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd) (?:bsd )?licen[sc]e|(?:2|two) clause bsd(?: licen[sc]e)?|bsd (?:2|two) clause(?: licen[sc]e)?", r"bsd 2 clause"),
    ("0bsd", "bsd", r"(?:zero|0) clause bsd(?: licen[sc]e)?|bsd zero clause(?: licen[sc]e)?", r"0bsd"),
    ("bsd", "bsd", r"bsd(?: style| type)? licen[sc]e", r"bsd"),
    ("isc", "isc", r"isc licen[sc]e", r"isc"),
    ("mpl-2", "mozilla", r"mozilla public licen[sc]e(?: version| v)? 2(?: 0)?", r"mpl (?:v ?)?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: version| v)? 1 1", r"mpl (?:v ?)?1 1"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", r"mpl"),
    ("epl-2", "eclipse", r"eclipse public licen[sc]e(?: version| v)? 2(?: 0)?", r"epl (?:v ?)?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public licen[sc]e(?: version| v)? 1(?: 0)?", r"epl (?:v ?)?1(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", r"epl"),
    ("edl-1", "eclipse", r"eclipse distribution licen[sc]e(?: version| v)?(?: 1(?: 0)?)?", r"edl (?:v ?)?1 0"),
    ("eupl-1.2", "european", r"european union public licen[sc]e(?: version| v)? 1 2", r"eupl (?:v ?)?1 2"),
    ("eupl", "european", r"european union public licen[sc]e", r"eupl"),
    ("cddl-1", "common", r"common development and distribution licen[sc]e(?: cddl)?(?: version| v)?(?: 1 [01])?", r"cddl (?:v ?)?1 [01]|cddl"),
    ("cpl-1", "common", r"common public licen[sc]e(?: version| v)?(?: 1(?: 0)?)?", r"cpl (?:v ?)?1 0"),
    ("cpal-1", "common", r"common public attribution licen[sc]e(?: version| v)?(?: 1(?: 0)?)?", r"cpal (?:v ?)?1 0"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", r"ms rl"),
    ("artistic-2", "artistic", r"(?:perl )?artistic licen[sc]e(?: version| v)? 2(?: 0)?", r"artistic 2 0"),
    ("artistic-1", "artistic", r"(?:perl )?artistic licen[sc]e", r"artistic 1 0(?: perl)?|artistic"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: version| v)?(?: 1(?: 0)?)?", r"bsl 1 0"),
    ("busl-1.1", "business", r"business source licen[sc]e(?: version| v)?(?: 1 1)?", r"busl 1 1"),
    ("sspl-1", "side", r"server side public licen[sc]e(?: version| v)?(?: 1(?: 0)?)?", r"sspl 1 0"),
    ("elastic-2", "elastic", r"elastic licen[sc]e(?: version| v)?(?: 2(?: 0)?)?", r"elastic 2 0"),
    ("zlib", "zlib", r"(?:zlib(?: libpng)?|libpng) licen[sc]e", r"zlib"),
    ("openssl", "openssl", r"openssl licen[sc]e", r"openssl"),
    ("php-3.01", "php", r"php licen[sc]e(?: version| v)?(?: 3 0 ?1?)?", r"php 3 01"),
    ("python-2", "python", r"(?:psf|python software foundation|python) licen[sc]e(?: version| v)?(?: 2(?: 0)?)?", r"psf 2 0|python 2 0"),
    ("ruby", "ruby", r"ruby licen[sc]e", r"ruby"),
    ("vim", "vim", r"vim licen[sc]e", r"vim"),
    ("tcl", "tcl", r"tcl(?: tk)? licen[sc]e", r"tcl"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e", r"ncsa"),
    ("upl-1", "universal", r"universal permissive licen[sc]e(?: version| v)?(?: 1(?: 0)?)?", r"upl 1 0"),
    ("ecl-2", "educational", r"educational community licen[sc]e(?: version| v)?(?: 2(?: 0)?)?", r"ecl 2 0"),
    ("afl-3", "academic", r"academic free licen[sc]e(?: version| v)?(?: [123] [01])?", r"afl 3 0"),
    ("osl-3", "open", r"open software licen[sc]e(?: version| v)?(?: [123] [01])?", r"osl 3 0"),
    ("ofl-1.1", "sil", r"sil open font licen[sc]e(?: version| v)?(?: 1 [01])?", r"ofl 1 1"),
    ("odbl-1", "database", r"open (?:data commons open )?database licen[sc]e(?: odbl)?(?: version| v)?(?: 1(?: 0)?)?", r"odbl (?:v ?)?1 0|odbl"),
    ("odc-by-1", "commons", r"open data commons attribution licen[sc]e(?: version| v)?(?: 1(?: 0)?)?", r"odc by (?:v ?)?1 0|odc by"),
    ("pddl-1", "commons", r"open data commons public domain dedication and licen[sc]e(?: version| v)?(?: 1(?: 0)?)?", r"pddl 1 0"),
    ("cdla-permissive-2", "community", r"community data licen[sc]e agreement permissive(?: version| v)?(?: [12] 0)?", r"cdla permissive [12] 0"),
    ("cdla-sharing-1", "community", r"community data licen[sc]e agreement sharing(?: version| v)?(?: 1 0)?", r"cdla sharing 1 0"),
    ("ogl-3", "government", r"open government licen[sc]e(?: version| v)?(?: [123](?: 0)?)?", r"ogl(?: uk)? [123] 0"),
    ("unlicense", "unlicense", r"unlicen[sc]e", r"unlicense"),
    ("wtfpl", "want", r"do what the fuck you want to public licen[sc]e(?: version| v)?(?: 2)?", r"wtfpl"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)? licen[sc]e(?: version| v)?(?: 2 [01])?", r"cecill 2 [01]|cecill"),
    ("mulan-2", "mulan", r"mulan (?:psl|permissive software licen[sc]e)(?: version| v)? ?v?2", r"mulanpsl 2 0"),
    ("openrail-m", "responsible", r"(?:creativeml |bigscience |open )+(?:open )?(?:rail|responsible ai licen[sc]e)(?: m)?", r"(?:creativeml |bigscience )?openrail(?: m)?"),
    ("cc-by-nc-nd", "noncommercial", r"(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: (?:[1234] [05]|international|licen[sc]e))*", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "noncommercial", r"(?:creative commons )?attribution non ?commercial share ?alike(?: (?:[1234] [05]|international|licen[sc]e))*", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc", "noncommercial", r"(?:creative commons )?attribution non ?commercial(?: (?:[1234] [05]|international|licen[sc]e))*", r"cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", "creative", r"(?:creative commons )attribution no ?deriv(?:ative)?s?(?: works)?(?: (?:[1234] [05]|international|licen[sc]e))*", r"cc by nd(?: [1234] [05])?"),
    ("cc-by-sa", "creative", r"(?:creative commons )attribution share ?alike(?: (?:[1234] [05]|international|licen[sc]e))*", r"cc by sa(?: [1234] [05])?"),
    ("cc-by", "creative", r"(?:creative commons )attribution(?: (?:[1234] [05]|international|licen[sc]e))*", r"cc by(?: [1234] [05])?"),
    ("cc0-1", "zero", r"(?:creative commons|cc) zero(?: (?:v?1 0|universal|licen[sc]e))*|cc0(?: (?:v?1 0|universal|licen[sc]e))*", r"cc0(?: 1 0)?"),
]

_VERB = r"(?:re)?(?:licen[sc]ed|leased|distributed|published|provided|offered|(?:made )?available|covered|governed|protected|shared|dedicated)"
_GRANT = _VERB + r"(?: for use| to you)? under(?: the)?(?: (?:terms|conditions)(?: and conditions)? of)?(?: (?:the|a|version))?"
#: Forms in which a license is stated: kind, priority, weight, topic, pattern with the name or the identifier.
FORMS = [
    ("identifier", 90, 1.0, "spdx", r"spdx licen[sc]e identifier (?:{id})"),
    ("grant", 80, 0.95, "licen", _GRANT + r" (?:{name})"),
    ("brief grant", 79, 0.95, " under ", _GRANT + r" (?:{id})(?: licen[sc]e)?"),
    ("field", 70, 0.85, "licen", r"licen[sc]e(?:s|d)?(?: (?:type|name|id|is|as))? (?:osi approved )?(?:{id})(?: licen[sc]e)?(?= |$)"),
    ("address", 70, 0.9, "org", r"(?:opensource org licenses?|spdx org licenses|creativecommons org licenses|gnu org licenses|choosealicense com licenses) (?:{bare})"),
    ("title", 60, 0.7, "licen", r"(?:the )?(?:{name})"),
]
#: Licenses whose identifier alone, in words, is a statement (no word of a language, nor a name of anything else).
ALONE = {
    "agpl-3", "lgpl-3", "lgpl-2.1", "lgpl-2", "gpl-3", "gpl-2", "mpl-2", "mpl-1.1", "epl-2", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc0-1",
    "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd", "wtfpl", "odbl-1",
}

#: Wording of the texts themselves: label, priority, weight, topic, keyword, pattern.
TEXTS = [
    ("mit", 75, 0.95, "permission", "granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?"),
    ("mit", 40, 0.5, "permission", "notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", 75, 0.9, "permission", "granted", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 75, 0.9, "redistribut", "binary", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 76, 0.9, "endorse", "endorse", r"neither the names? of [^\n]{1,120}? may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 76, 0.9, "advertising", "acknowledg", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", 75, 0.95, "licen", "apache", r"you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at(?: https?)? (?:www )?apache org licenses license 2 0"),
    ("gpl-3-or-later", 85, 0.95, "gnu", "general", r"(?:terms of the )?gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl-2-or-later", 85, 0.95, "gnu", "general", r"(?:terms of the )?gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version"),
    ("lgpl-2.1-or-later", 85, 0.95, "gnu", "lesser", r"(?:terms of the )?gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version"),
    ("lgpl-3-or-later", 85, 0.95, "gnu", "lesser", r"(?:terms of the )?gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("agpl-3-or-later", 85, 0.95, "gnu", "affero", r"(?:terms of the )?gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("mpl-2", 75, 0.95, "mozilla", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("unlicense", 75, 0.95, "public domain", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 75, 0.95, "want to", "fuck", r"you just do what the fuck you want to"),
    ("zlib", 75, 0.9, "warranty", "damages", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("bsl-1.0", 75, 0.95, "permission", "granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("artistic-2", 75, 0.9, "licen", "package", r"this licen[sc]e establishes the terms under which a given free software package may be copied modified distributed"),
    ("ofl-1.1", 75, 0.9, "font", "font", r"this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1"),
    ("cc0-1", 75, 0.9, "public domain", "waive", r"(?:has|have) waived all copyright and related or neighboring rights"),
    ("public-domain", 50, 0.8, "public domain", "domain", r"(?:is|are|released|placed|dedicated|put)(?: (?:hereby|in|into|to|this work))* the public domain"),
    ("proprietary", 20, 0.4, "rights reserved", "reserved", r"all rights reserved"),
    ("proprietary", 45, 0.8, "confidential", "proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", 45, 0.8, "permission", "unauthorized", r"unauthori[sz]ed (?:copying|reproduction|use|distribution) of this (?:file|work|software|material) [^\n]{0,80}?(?:is )?(?:strictly )?prohibited"),
    ("unstated", 10, 0.3, "licen", "licen", r"(?:see|refer to) the(?: accompanying)?(?: file)? (?:licen[sc]e|copying|licen[sc]e (?:txt|md))(?: file)? for (?:details|more information|the full)"),
    ("unstated", 10, 0.3, "licen", "licen", r"licen[sc]ed under(?: the)? (?:same|following) (?:terms|licen[sc]e)"),
]


@dataclass(frozen=True)
class Rule:
    """One signature: what it says, where it ranks, and what a text must hold before it is tried."""

    label: str
    kind: str
    priority: int
    weight: float
    topic: bytes
    keyword: bytes
    pattern: re.Pattern
    base: bool = False


def _rule(label: str, kind: str, priority: int, weight: float, topic: str, keyword: str, pattern: str, base: bool = False) -> Rule:
    whole = re.compile(rf"(?:(?<= )|^)(?:{pattern})(?= |$)".encode())
    return Rule(label, kind, priority, weight, topic.encode(), keyword.encode(), whole, base)


def _short(identifier: str) -> str:
    """The longest word that every form of an identifier holds, with its separators."""
    words = [option.split() for option in re.sub(r"\(\?:[^()]*\)\??", "", identifier).split("|")]
    shared = [w for w in (words[0] or [""]) if all(w in other for other in words) and w.isalnum()]
    best = max(shared, key=len, default="")
    return f" {best} " if best else ""


def rules() -> list[Rule]:
    """All rules in their order: by priority, then as listed."""
    made = [_rule(label, "phrase", 100, 0.9, phrase.split()[0], phrase.split()[-1], phrase, base=True) for phrase, label in BASE.items()]
    for label, keyword, name, identifier in LICENSES:
        bare = identifier.replace("cc ", "") if label.startswith("cc-") else identifier
        for kind, priority, weight, topic, form in FORMS:
            if kind == "address" and not bare:
                continue
            held = keyword if kind in ("title", "grant") else _short(bare if kind == "address" else identifier)
            made.append(_rule(label, kind, priority, weight, topic, held, form.format(name=name, id=identifier, bare=bare)))
        if label in ALONE:
            made.append(_rule(label, "alone", 55, 0.6, _short(identifier), _short(identifier), identifier))
    made += [_rule(label, "text", priority, weight, topic, keyword, pattern) for label, priority, weight, topic, keyword, pattern in TEXTS]
    return sorted(made, key=lambda r: -r.priority)


_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(32 if b in set(_SEPARATORS) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def normalised(text: str) -> bytes:
    """Words of a text in UTF-8 with single spaces between them."""
    raw = np.frombuffer(text.encode("utf-8", "replace").translate(_TABLE), dtype=np.uint8)
    word = raw != 32
    keep = word.copy()
    keep[1:] |= word[:-1]
    out = raw[keep].tobytes()
    # One separator is kept behind each word; words never start with one.
    return out[:-1] if out.endswith(b" ") else out


class Scanner:
    """Applies rules to texts; compiled once for each worker."""

    def __init__(self, made: list[Rule] | None = None):
        self.rules = rules() if made is None else made
        self.topics: dict[bytes, dict[bytes, list[int]]] = {}
        for i, rule in enumerate(self.rules):
            self.topics.setdefault(rule.topic, {}).setdefault(rule.keyword, []).append(i)

    def gated(self, words: bytes) -> list[int]:
        """Rules whose topic and keyword occur."""
        words, out = b" " + words + b" ", []
        for topic, keywords in self.topics.items():
            if topic in words:
                out += [i for keyword, held in keywords.items() if keyword in words for i in held]
        return sorted(out)

    def __call__(self, text: str | None) -> tuple[int, list[dict]]:
        """Number of words, and the detections that stay, by start, then end, then label."""
        words = normalised(text or "")
        if not words:
            return 0, []
        gaps = np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 32)
        found = []
        for i in self.gated(words):
            for m in self.rules[i].pattern.finditer(words):
                found.append((i, m.start(), m.end()))
        kept = suppressed(found, self.rules)
        spans = [
            {
                "start": int(np.searchsorted(gaps, start)), "end": int(np.searchsorted(gaps, end)) + 1, "label": self.rules[i].label,
                "kind": self.rules[i].kind, "weight": self.rules[i].weight, "base": self.rules[i].base,
            }
            for i, start, end in kept
        ]
        return len(gaps) + 1, sorted(spans, key=lambda s: (s["start"], s["end"], s["label"], s["kind"]))


def suppressed(found: list[tuple[int, int, int]], made: list[Rule]) -> list[tuple[int, int, int]]:
    """Detections (rule, start, end) that lie within none kept before them; those of base rules all stay.

    They are taken by priority, then the longer, the earlier, and the rule first in order. The kept intervals
    that contain no other are held by start, so that their ends rise as well and one look decides.
    """
    kept, starts, ends = [], [], []
    for i, start, end in sorted(found, key=lambda d: (-made[d[0]].priority, d[1] - d[2], d[1], d[0])):
        if made[i].base:
            kept.append((i, start, end))
            continue
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((i, start, end))
        # Intervals within the new one can't decide anything that it doesn't.
        low, high = bisect_left(starts, start), bisect_right(ends, end)
        starts[low:high], ends[low:high] = [start], [end]
    return kept


DETECTION = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()),
            T.StructField("kind", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("base", T.BooleanType()),
        ]
    )
)

_scanner: list[Scanner] = []


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words``, ``detections`` (words from 0, end exclusive) and ``score`` to every row.

    Null and empty texts have no words and no detections, and score 0. The
    score is the chance that any label holds, with the best weight of each
    label taken as independent. Columns of these names are replaced; repeated
    rows are each scanned. Texts are scanned whole, a few MB at a time.
    """

    def make(texts: list) -> list:
        if not _scanner:
            _scanner.append(Scanner())
        done = [_scanner[0](t) for t in texts]
        return [[n for n, _ in done], [spans for _, spans in done], [score(spans) for _, spans in done]]

    added = [T.StructField("n_words", T.LongType()), T.StructField("detections", DETECTION), T.StructField("score", T.DoubleType())]
    return mapped(df, text_col, added, make)


def score(spans: list[dict]) -> float:
    """Chance that one of the labels holds."""
    best: dict[str, float] = {}
    for s in spans:
        best[s["label"]] = max(best.get(s["label"], 0.0), s["weight"])
    missed = 1.0
    for label in sorted(best):
        missed *= 1 - best[label]
    return 1 - missed


def labels(detections: str = "detections", base_only: bool = False):
    """Distinct labels, sorted and joined by commas."""
    held = F.filter(detections, lambda d: d["base"]) if base_only else F.col(detections)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(held, lambda d: d["label"]))), ",")
