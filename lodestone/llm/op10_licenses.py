"""Licence scans: ordered signature rules behind a keyword prefilter; overlapping detections are resolved by priority."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import map_slices, table

_LETTER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(f"{_LETTER}+")

#: Phrases whose words stand consecutively, with their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Families: label, keyword that a text must have, and the name as a pattern over lower-case text.
FAMILIES = (
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e,? (?:version |v)?1\.1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e"),
    ("mit", "mit", r"(?:mit|expat|x11) licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified|2-clause|two-clause|freebsd) bsd licen[sc]e|bsd[ -]2[ -]clause(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3-clause|three-clause) bsd licen[sc]e|bsd[ -]3[ -]clause(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original|4-clause|four-clause) bsd licen[sc]e|bsd[ -]4[ -]clause(?: licen[sc]e)?"),
    ("bsd", "bsd", r"bsd licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[sc]e,?(?: as published by the free software foundation[,;]? either)? (?:version|v) ?1(?:\.0)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e,?(?: as published by the free software foundation[,;]? either)? (?:version|v) ?2(?:\.0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e,?(?: as published by the free software foundation[,;]? either)? (?:version|v) ?3(?:\.0)?"),
    ("gpl-2.0", "gpl", r"gpl[ -]?v?2(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl-3.0", "gpl", r"gpl[ -]?v?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e,? (?:version|v) ?2\.1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e,? (?:version|v) ?3(?:\.0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public licen[sc]e"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e,? (?:version|v) ?3(?:\.0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e,? (?:version |v\.? ?)?1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e,? (?:version |v\.? ?)?1(?:\.0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e"),
    ("eupl-1.2", "european union", r"european union public licen[sc]e"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e,? (?:version )?2(?:\.0)?"),
    ("artistic", "artistic", r"artistic licen[sc]e"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e"),
    ("boost-1.0", "boost", r"boost software licen[sc]e(?:,? (?:version )?1\.0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[sc]e)?"),
    ("public-domain", "public domain", r"public domain"),
    ("odbl", "open database", r"open database licen[sc]e"),
    ("ofl-1.1", "open font", r"sil open font licen[sc]e"),
    ("psf-2.0", "python", r"python software foundation licen[sc]e"),
    ("cc0-1.0", "cc0", r"cc0(?:[ -]1\.0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", r"cc[ -]by[ -]nc[ -]nd(?:[ -]\d\.\d)?"),
    ("cc-by-nc-sa", "cc", r"cc[ -]by[ -]nc[ -]sa(?:[ -]\d\.\d)?"),
    ("cc-by-nc", "cc", r"cc[ -]by[ -]nc(?:[ -]\d\.\d)?"),
    ("cc-by-nd", "cc", r"cc[ -]by[ -]nd(?:[ -]\d\.\d)?"),
    ("cc-by-sa", "cc", r"cc[ -]by[ -]sa(?:[ -]\d\.\d)?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution[ -]non-?commercial[ -]share-?alike"),
    ("cc-by-nc", "creative commons", r"creative commons attribution[ -]non-?commercial"),
    ("cc-by-nd", "creative commons", r"creative commons attribution[ -]no-?deriv(?:ative)?s"),
    ("cc-by-sa", "creative commons", r"creative commons attribution[ -]share-?alike"),
    ("cc-by", "creative commons", r"creative commons attribution"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|licen[sc]e|software)"),
)
#: Sentences of licence texts: label, keyword, pattern.
SENTENCES = (
    ("apache-2.0", "license", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "perpetual", r"grant(?:s|ed)? to you a perpetual,? worldwide,? non-?exclusive,? no-?charge,? royalty-?free,? irrevocable (?:copyright|patent) licen[sc]e"),
    ("apache-2.0", "derivative works", r"you must cause any modified files to carry prominent notices"),
    ("apache-1.1", "acknowledgment", r"this product includes software developed by the apache software foundation"),
    ("mit", "permission is hereby", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("mit", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit-0", "without restriction", r"to deal in the software without restriction,? including without limitation"),
    ("isc", "permission to use", r"permission to use,? copy,? modify,? and/or distribute this software for any purpose"),
    ("hpnd", "permission to use", r"permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose"),
    ("0bsd", "any purpose", r"for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("gpl", "free software", r"this (?:program|library|file) is free software[;:,]? you can redistribute it"),
    ("gpl", "without any warranty", r"distributed in the hope that it will be useful,? but without any warranty"),
    ("gpl", "you should have received", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public licen[sc]e"),
    ("gpl", "freedom to share", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom"),
    ("gpl-3.0", "convey", r"you may convey verbatim copies of the program's source code"),
    ("gpl-2.0", "verbatim copies", r"you may copy and distribute verbatim copies of the program's source code"),
    ("gpl-3.0", "patent", r"each contributor grants you a non-?exclusive,? worldwide,? royalty-?free patent licen[sc]e under the contributor's essential"),
    ("lgpl", "library", r"a work that uses the library"),
    ("lgpl-3.0", "combined work", r"you may convey a combined work under terms of your choice"),
    ("agpl-3.0", "network", r"users interacting with it remotely through a computer network"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[sc]e"),
    ("mpl-2.0", "covered software", r"covered software is provided under this licen[sc]e on an [\"“']?as is[\"”']? basis"),
    ("epl-2.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse"),
    ("epl-1.0", "commercial distributor", r"commercial distributors of software may accept certain responsibilities"),
    ("cddl-1.0", "common development", r"the contents of this file are subject to the terms of the common development"),
    ("eupl-1.2", "eupl", r"you may not use this work except in compliance with the licen[cs]e.{0,20}eupl"),
    ("artistic-2.0", "standard version", r"you may distribute verbatim copies of the source form of the standard version"),
    ("artistic", "artistic control", r"copyright holder maintains some semblance of artistic control"),
    ("zlib", "express or implied", r"this software is provided [\"“']?as-is[\"”']?,? without any express or implied warranty"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("boost-1.0", "machine-executable", r"machine-executable object code generated by a source language processor"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate", r"dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "you just", r"you just do what the fuck you want to"),
    ("odbl", "database", r"share-?alike for data/?databases"),
    ("ofl-1.1", "font software", r"the font software may be modified,? altered,? or added to"),
    ("ofl-1.1", "reserved font", r"with reserved font name"),
    ("psf-2.0", "psf", r"psf is making python available to licensee"),
    ("cc0-1.0", "waive", r"to the extent possible under law,? .{0,60}waived all copyright"),
    ("cc-by", "appropriate credit", r"you must give appropriate credit,? provide a link to the licen[sc]e"),
    ("cc-by-sa", "remix", r"if you remix,? transform,? or build upon the material,? you must distribute"),
    ("cc-by-nc", "commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "remix", r"if you remix,? transform,? or build upon the material,? you may not distribute"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("json", "good, not evil", r"the software shall be used for good,? not evil"),
    ("ms-pl", "contributor", r"a contributor is any person that distributes its contribution under this licen[sc]e"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("openssl", "eric young", r"this product includes cryptographic software written by eric young"),
    ("php", "php", r"this product includes php software,? freely available"),
    ("ruby", "verbatim copies", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("unicode", "unicode", r"permission is hereby granted.{0,60}unicode data files"),
    ("w3c", "w3c", r"w3c software (?:and document )?notice and licen[sc]e"),
    ("curl", "stenberg", r"copyright.{0,40}daniel stenberg"),
    ("proprietary", "confidential", r"contains (?:confidential|proprietary)(?: and (?:confidential|proprietary))? information of"),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution).{0,60}is (?:strictly )?prohibited"),
    ("proprietary", "trade secret", r"trade secrets? (?:of|and)"),
    ("proprietary", "written consent", r"without (?:the )?(?:prior |express )*written (?:consent|permission) of"),
    ("proprietary", "reverse engineer", r"(?:may|shall) not reverse engineer,? decompile,? or disassemble"),
    ("proprietary", "end user", r"end[ -]user licen[sc]e agreement"),
    ("non-commercial", "non", r"for non-?commercial (?:use|purposes) only"),
    ("non-commercial", "personal use", r"for (?:your )?personal use only"),
    ("research-only", "research", r"for (?:academic |scientific )?research (?:use|purposes) only"),
    ("evaluation", "evaluation", r"for evaluation (?:use|purposes) only"),
    ("reserved", "no part of", r"no part of this (?:publication|work|book|document) may be reproduced"),
    ("reserved", "retrieval system", r"stored in a retrieval system,? or transmitted"),
    ("free-use", "free to use", r"free to use(?:,? (?:copy|share|modify))+"),
    ("public-domain", "no rights", r"no rights reserved"),
    ("public-domain", "copyright", r"not subject to copyright protection"),
    ("permission", "reprinted", r"reprinted (?:here )?(?:with|by) (?:kind )?permission"),
    ("permission", "used with", r"used with (?:kind )?permission"),
    ("open-government", "open government", r"contains public sector information licensed under the open government licen[sc]e"),
    ("free-documentation", "front-cover", r"with no invariant sections,? no front-cover texts"),
    ("rail", "use-based", r"use-based restrictions"),
    ("llama", "meta platforms", r"meta platforms,? inc\. all rights reserved"),
    ("warranty-disclaimer", "as is", r"(?:software|work|library|code) is provided [\"“']?as is[\"”']?"),
    ("warranty-disclaimer", "merchantability", r"warrant(?:y|ies) of merchantability"),
    ("liability-disclaimer", "in no event", r"in no event shall .{0,80} be liable"),
    ("liability-disclaimer", "liability", r"(?:holders?|authors?) disclaims? all liability"),
)
#: Web addresses of licences: label, keyword, pattern.
ADDRESSES = (
    ("apache-2.0", "apache.org", r"apache\.org/licenses/license-2\.0"), ("apache-1.1", "apache.org", r"apache\.org/licenses/license-1\.1"),
    ("mit", "opensource.org", r"opensource\.org/licenses?/mit\b"), ("bsd-2-clause", "opensource.org", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "opensource.org", r"opensource\.org/licenses?/bsd-3-clause"), ("isc", "opensource.org", r"opensource\.org/licenses?/isc\b"),
    ("artistic-2.0", "opensource.org", r"opensource\.org/licenses?/artistic-2\.0"), ("ms-pl", "opensource.org", r"opensource\.org/licenses?/ms-pl"),
    ("gpl-1.0", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"), ("gpl-2.0", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gnu.org", r"gnu\.org/licenses/gpl-3\.0"), ("lgpl-2.1", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "gnu.org", r"gnu\.org/licenses/lgpl-3\.0"), ("agpl-3.0", "gnu.org", r"gnu\.org/licenses/agpl-3\.0"),
    ("free-documentation", "gnu.org", r"gnu\.org/licenses/fdl"), ("gpl", "gnu.org", r"gnu\.org/(?:licenses/(?:gpl\.html)?|copyleft)(?![\w-])"),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/2\.0"), ("mpl-1.1", "mozilla.org", r"mozilla\.org/mpl/(?:mpl-)?1\.1"),
    ("epl-2.0", "eclipse.org", r"eclipse\.org/legal/epl-2\.0"), ("epl-1.0", "eclipse.org", r"eclipse\.org/legal/epl-v10"),
    ("cc0-1.0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0"), ("public-domain", "creativecommons.org", r"creativecommons\.org/publicdomain/mark"),
    ("cc-by", "creativecommons.org", r"creativecommons\.org/licenses/by/\d"), ("cc-by-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-sa/\d"),
    ("cc-by-nc", "creativecommons.org", r"creativecommons\.org/licenses/by-nc/\d"), ("cc-by-nd", "creativecommons.org", r"creativecommons\.org/licenses/by-nd/\d"),
    ("cc-by-nc-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa/\d"), ("cc-by-nc-nd", "creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd/\d"),
    ("unlicense", "unlicense.org", r"unlicense\.org"), ("wtfpl", "wtfpl.net", r"wtfpl\.net"), ("boost-1.0", "boost.org", r"boost\.org/license_1_0"),
    ("ofl-1.1", "sil.org", r"scripts\.sil\.org/ofl"), ("zlib", "zlib.net", r"zlib\.net/zlib_license"), ("odbl", "opendatacommons", r"opendatacommons\.org/licenses/odbl"),
    ("open-government", "nationalarchives", r"nationalarchives\.gov\.uk/doc/open-government-licen[cs]e"), ("eupl-1.2", "europa.eu", r"europa\.eu/software/page/eupl"),
)
#: Further names and abbreviations: label, keyword, pattern.
NAMES = (
    ("beerware", "beer", r"beer-?ware licen[sc]e"), ("ms-pl", "microsoft", r"microsoft public licen[sc]e"), ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"), ("php", "php", r"php licen[sc]e"), ("ruby", "ruby", r"ruby licen[sc]e"), ("vim", "vim", r"vim licen[sc]e"),
    ("w3c", "w3c", r"w3c (?:software )?licen[sc]e"), ("json", "json", r"json licen[sc]e"), ("curl", "curl", r"curl licen[sc]e"), ("unicode", "unicode", r"unicode licen[sc]e"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e"), ("cpl-1.0", "common public", r"common public licen[sc]e"), ("ipl-1.0", "ibm", r"ibm public licen[sc]e"),
    ("osl-3.0", "open software", r"open software licen[sc]e"), ("afl-3.0", "academic free", r"academic free licen[sc]e"), ("qpl-1.0", "q public", r"q public licen[sc]e"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e"), ("busl-1.1", "business source", r"business source licen[sc]e"), ("elastic-2.0", "elastic", r"elastic licen[sc]e"),
    ("commons-clause", "commons clause", r"commons clause"), ("rail", "rail", r"(?:open|creativeml|bigscience)[ -](?:open)?rail(?:-?m)?(?: licen[sc]e)?"), ("llama", "llama", r"llama ?\d? community licen[sc]e"),
    ("gemma", "gemma", r"gemma terms of use"), ("free-documentation", "documentation", r"gnu free documentation licen[sc]e"), ("open-government", "open government", r"open government licen[sc]e"),
    ("odc-by", "open data", r"open data commons attribution licen[sc]e"), ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e"), ("cdla", "community data", r"community data licen[sc]e agreement"),
    ("cecill", "cecill", r"cecill(?:-[abc])?"), ("mulan-psl-2.0", "mulan", r"mulan (?:psl|permissive software licen[sc]e)"), ("blue-oak", "blue oak", r"blue oak model licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e"), ("postgresql", "postgresql", r"postgresql licen[sc]e"), ("nasa-1.3", "nasa", r"nasa open source agreement"),
    ("lppl", "latex", r"latex project public licen[sc]e"), ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"), ("lgpl-2.1", "lgpl", r"lgpl[ -]?v?2\.1\+?"), ("lgpl-3.0", "lgpl", r"lgpl[ -]?v?3(?:\.0)?\+?"),
    ("agpl-3.0", "agpl", r"agpl[ -]?v?3(?:\.0)?\+?"), ("gpl", "gnu gpl", r"gnu gpl"), ("mpl-2.0", "mpl", r"mpl[ -]?2\.0"), ("epl-2.0", "epl", r"epl[ -]?2\.0"), ("cc-pd", "cc pdm", r"cc pdm"),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?\d{4}(?: ?[-,–] ?\d{4})*"), ("copyright", "copyright", r"copyright holders?"), ("copyright", "©", r"© ?\d{4}"),
)
#: A tag of a source file names its licence.
_TAG = r"spdx-license-identifier: ?([a-z0-9][a-z0-9.+-]{0,39})"
#: Words before a name that say that it licenses this text, and so raise its confidence.
_CONTEXT = re.compile(
    r"(?:licen[sc]ed|distributed|released|published|available|provided|governed by|covered by|subject to|under)(?: to you)?(?: under| by)?(?: the)?(?: terms(?: and conditions)? of)?(?: the)? $"
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules, the one of highest priority first: tags, addresses, sentences, then names; copyright notices last."""
    whole = lambda pattern: re.compile(rf"(?<!\w)(?:{pattern})(?!\w)")
    out = [Rule("", "spdx", re.compile(_TAG), 100, 1.0)]
    out += [Rule(label, word, re.compile(pattern), 90, 0.95) for label, word, pattern in ADDRESSES]
    out += [Rule(label, word, whole(pattern), 30 if "disclaimer" in label else 80, 0.5 if "disclaimer" in label else 0.9) for label, word, pattern in SENTENCES]
    out += [Rule(label, word, whole(pattern), 20 if label == "copyright" else 60 - k // 100, 0.4 if label == "copyright" else 0.6) for k, (label, word, pattern) in enumerate((*FAMILIES, *NAMES))]
    return sorted(out, key=lambda r: -r.priority)


#: A line break with the white space and comment marks around it, or other white space that isn't one plain space.
_WRAP = re.compile(r"[^\S\n]*+\n\s*+(?:(?:/\*++|\*++/?|//++|\#++|;++|--++|>++|%++|!++|\.\.|dnl\b|rem\b)\s*+)*+|[^\S\n]{2,}+|[^\S\n ]")


class Folded:
    """A text with each wrap as one space, so that signatures find headers of source files; ``back`` gives places in the text."""

    def __init__(self, text: str):
        self._original, self.text = text, _WRAP.sub(" ", text)
        self._places: tuple[list[int], list[int]] | None = None

    def back(self, place: int, end: bool = False) -> int:
        """The place in the text of a place in the folded text; of an end, that behind its last character."""
        if self._places is None:
            starts, shifts, shift = [0], [0], 0
            for m in _WRAP.finditer(self._original):
                shift += m.end() - m.start() - 1
                starts.append(m.end() - shift)
                shifts.append(shift)
            self._places = starts, shifts
        starts, shifts = self._places
        at = place - end
        return at + shifts[bisect.bisect_right(starts, at) - 1] + end


class Cover:
    """Intervals of which none holds another, by start and so by end."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Whether no interval holds this one; if so it is added, in place of those that it holds."""
        k = bisect.bisect_right(self.starts, start)
        if k and self.ends[k - 1] >= end:
            return False
        first, last = bisect.bisect_left(self.starts, start), bisect.bisect_right(self.ends, end)
        self.starts[first:last], self.ends[first:last] = [start], [end]
        return True


def lower(text: str) -> str:
    """A-Z to a-z, nothing else."""
    return text.encode().lower().decode()


class Scanner:
    """Detections of a text; a rule runs only if the text has its keyword."""

    def __init__(self) -> None:
        by: dict[str, list[Rule]] = {}
        for rule in rules():
            by.setdefault(rule.keyword, []).append(rule)
        self.by = by
        self.gate = ahocorasick.Automaton()
        for word in [*by, "cc", "general", "rights"]:
            self.gate.add_word(word, word)
        self.gate.make_automaton()
        self.phrases = [(label, p.split()[0], re.compile(f"(?<!{_LETTER}){_GAP.join(p.split())}(?!{_LETTER})")) for p, label in PHRASES.items()]

    def detections(self, text: str, words: set[str]) -> list[tuple[int, int, str, int, float]]:
        """Start, end, label, priority and confidence of what stands after suppression.

        In order of priority, then length, then place, a detection falls if one that stands holds its interval. Where
        words before a name say that it licenses the text, its confidence is higher.
        """
        found = []
        for rule in (r for w in sorted(words) for r in self.by.get(w, ())):
            for m in rule.pattern.finditer(text):
                said = 50 <= rule.priority <= 60 and _CONTEXT.search(text, max(0, m.start() - 60), m.start())
                found.append((*m.span(), rule.label or m[1], rule.priority, 0.9 if said else rule.confidence))
        found.sort(key=lambda d: (-d[3], d[0] - d[1], d[0], d[2]))
        cover = Cover()
        return sorted(d for d in found if cover.add(d[0], d[1]))

    def scan(self, original: str | None) -> dict:
        text = lower(original or "")
        folded = Folded(text)
        words = {w for _, w in self.gate.iter(folded.text)}
        places, labels = [], set()
        for label, first, pattern in self.phrases if words else ():
            if first in words or first == "all":
                for m in pattern.finditer(text):
                    places.append(m.start())
                    labels.add(label)
        found = [(folded.back(a), folded.back(b, end=True), *rest) for a, b, *rest in self.detections(folded.text, words)] if words else []
        starts = [len(_WORD.findall(text, 0, p)) for p in (min(places), max(places))] if places else [None, None]
        return {
            "n_words": len(_WORD.findall(text)), "n_base": len(places), "first_word": starts[0], "last_word": starts[1],
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {d[2] for d in found})),
            "score": max([d[4] for d in found] + [0.5] * bool(places), default=0.0),
            "detections": [{"start": a, "end": b, "label": x, "priority": p, "confidence": c} for a, b, x, p, c in found],
        }


DETECTION = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("confidence", T.DoubleType())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, counts and places of the phrases, labels, score and detections.

    Signatures see line breaks with white space and comment marks, and other runs of white space, as one space; places are
    those of the text as it is. A null text counts as empty: no words, no labels, score 0. Time grows linearly with a text, of any length, but for a
    logarithm of its detections. Repeated rows stay; an empty table gives no rows; columns
    besides the two named are not read.
    """
    fields = [T.StructField(k, T.LongType()) for k in ("n_words", "n_base", "first_word", "last_word")]
    fields += [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("detections", T.ArrayType(DETECTION))]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *fields])

    def make():
        scanner = Scanner()

        def work(part):
            rows = [scanner.scan(t) for t in part["text"]]
            return {"id": part["id"]} | {f.name: [r[f.name] for r in rows] for f in fields}

        return work

    out = map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", make, schema)
    return out.withColumnRenamed("id", id_col)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("detections")


QUERIES = {"op10_licenses": op10_licenses}
ORACLE: dict[str, str] = {}
