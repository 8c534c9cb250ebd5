"""License notices in texts: ordered signature rules behind a keyword prefilter, overlaps resolved.

Rules are regular expressions over the words of a text (lower case, one space
between words, one at both ends), so line breaks, comment signs and
punctuation do not matter.  A rule is tried only in texts that hold all its
keywords, which one automaton finds for all rules.  What is matched is an
interval of words; one that lies inside another of higher or equal rank goes.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelake.llm import arrays as A

#: Phrases that are always told, by label.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Kinds of rules in the order of their rank, with the confidence of a match.
KINDS = {"tag": 1.0, "notice": 0.95, "text": 0.9, "url": 0.85, "name": 0.7, "hint": 0.4}

#: How a license is granted, before its name.
GRANT = (
    r"(?:(?:re)?licen[cs]ed|released|distributed|available|provided|published|covered|governed|made available|dual licen[cs]ed)"
    r"(?: to you)? (?:under|by|subject to|pursuant to|according to) (?:the )?(?:terms (?:and conditions )?(?:of|in) )?(?:the |an? )?"
)
LICENSE = r"(?:(?: public)? licen[cs]es?)?"
VERSION = r"(?: (?:version|v|ver))?"

#: Names of licenses, one a line: label, tag (an SPDX identifier split to words, or -), name.
#: A name is a regular expression over words; ~ stands for an optional word "version".
NAMES = r"""
mit | mit | (?:mit|expat|x11 mit) licen[cs]e
mit-0 | mit 0 | mit no attribution(?: licen[cs]e)?
apache-1.0 | apache 1 0 | apache(?: software)? licen[cs]e~ 1(?: 0)?(?! 1)
apache-1.1 | apache 1 1 | apache(?: software)? licen[cs]e~ 1 1
apache-2.0 | apache 2 0 | apache(?: software)? licen[cs]e~ 2(?: 0)?
bsd-0-clause | 0bsd | (?:0bsd|zero clause bsd licen[cs]e|bsd zero clause licen[cs]e)
bsd-2-clause | bsd 2 clause | (?:simplified|freebsd|two clause|2 clause) bsd licen[cs]e|bsd (?:2|two) clause(?: licen[cs]e)?
bsd-3-clause | bsd 3 clause | (?:new|revised|modified|three clause|3 clause) bsd licen[cs]e|bsd (?:3|three) clause(?: licen[cs]e)?
bsd-4-clause | bsd 4 clause | (?:original|old|four clause|4 clause) bsd licen[cs]e|bsd (?:4|four) clause(?: licen[cs]e)?
bsd | - | bsd(?: style)? licen[cs]e
isc | isc | isc licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
libpng | libpng(?: 2 0)? | libpng licen[cs]e~(?: 2(?: 0)?)?
bsl-1.0 | bsl 1 0 | boost software licen[cs]e(?:~ 1(?: 0)?)?
unlicense | unlicense | (?:the )?unlicense(?: licen[cs]e)?
wtfpl | wtfpl | (?:wtfpl|do what the f[^ ]* you want to public licen[cs]e)
beerware | beerware | beer ?ware licen[cs]e
gpl-1.0 | gpl 1 0(?: only| or later)? | (?:gnu )?(?:gpl|general public licen[cs]e)~ 1(?: 0)?
gpl-2.0 | gpl 2 0(?: only| or later)? | (?:gnu )?(?:gpl|general public licen[cs]e)(?: gpl)?~ 2(?: 0)?
gpl-3.0 | gpl 3 0(?: only| or later)? | (?:gnu )?(?:gpl|general public licen[cs]e)(?: gpl)?~ 3(?: 0)?
gpl-2.0-short | - | (?:gplv2|gpl2)
gpl-3.0-short | - | (?:gplv3|gpl3)
gpl | - | (?:gnu )?general public licen[cs]e|gnu gpl
lgpl-2.0 | lgpl 2 0(?: only| or later)? | (?:gnu )?(?:lgpl|l(?:ibrary|esser) general public licen[cs]e)(?: lgpl)?~ 2(?: 0)?(?! 1)
lgpl-2.1 | lgpl 2 1(?: only| or later)? | (?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: lgpl)?~ 2 1
lgpl-3.0 | lgpl 3 0(?: only| or later)? | (?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: lgpl)?~ 3(?: 0)?
lgpl | - | (?:gnu )?l(?:ibrary|esser) general public licen[cs]e|gnu lgpl
agpl-1.0 | agpl 1 0(?: only| or later)? | affero general public licen[cs]e~ 1(?: 0)?
agpl-3.0 | agpl 3 0(?: only| or later)? | (?:gnu )?(?:agpl|affero general public licen[cs]e)(?: agpl)?~ 3(?: 0)?
agpl | - | (?:gnu )?affero general public licen[cs]e|gnu agpl|agplv3
gfdl-1.1 | gfdl 1 1(?: only| or later)? | (?:gnu )?(?:gfdl|free documentation licen[cs]e)~ 1 1
gfdl-1.2 | gfdl 1 2(?: only| or later)? | (?:gnu )?(?:gfdl|free documentation licen[cs]e)~ 1 2
gfdl-1.3 | gfdl 1 3(?: only| or later)? | (?:gnu )?(?:gfdl|free documentation licen[cs]e)~ 1 3
gfdl | - | (?:gnu )?free documentation licen[cs]e
mpl-1.0 | mpl 1 0 | (?:mozilla public licen[cs]e|mpl)~ 1(?: 0)?(?! 1)
mpl-1.1 | mpl 1 1 | (?:mozilla public licen[cs]e|mpl)~ 1 1
mpl-2.0 | mpl 2 0(?: no copyleft exception)? | (?:mozilla public licen[cs]e|mpl)~ 2(?: 0)?
mpl | - | mozilla public licen[cs]e
epl-1.0 | epl 1 0 | (?:eclipse public licen[cs]e|epl)~ 1(?: 0)?
epl-2.0 | epl 2 0 | (?:eclipse public licen[cs]e|epl)~ 2(?: 0)?
epl | - | eclipse public licen[cs]e
cddl-1.0 | cddl 1 0 | (?:common development and distribution licen[cs]e|cddl)(?: cddl)?~ 1(?: 0)?
cddl-1.1 | cddl 1 1 | (?:common development and distribution licen[cs]e|cddl)(?: cddl)?~ 1 1
cddl | - | common development and distribution licen[cs]e
cpl-1.0 | cpl 1 0 | common public licen[cs]e(?:~ 1(?: 0)?)?
cpal-1.0 | cpal 1 0 | common public attribution licen[cs]e(?:~ 1(?: 0)?)?
ipl-1.0 | ipl 1 0 | ibm public licen[cs]e(?:~ 1(?: 0)?)?
eupl-1.1 | eupl 1 1 | (?:european union public licen[cs]e|eupl)~ 1 1
eupl-1.2 | eupl 1 2 | (?:european union public licen[cs]e|eupl)~ 1 2
eupl | - | european union public licen[cs]e
artistic-1.0 | artistic 1 0(?: perl| cl8)? | artistic licen[cs]e~ 1(?: 0)?
artistic-2.0 | artistic 2 0 | artistic licen[cs]e~ 2(?: 0)?
artistic | - | artistic licen[cs]e|same terms as perl(?: itself)?
python-2.0 | python 2 0 | (?:python software foundation|psf) licen[cs]e(?:~ 2(?: 0)?)?
php-3.01 | php 3 01 | php licen[cs]e~ 3 01
php-3.0 | php 3 0 | php licen[cs]e~ 3(?: 0)?(?! 01)
ruby | ruby | ruby licen[cs]e|same terms as ruby
openssl | openssl | openssl licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e
ms-pl | ms pl | microsoft public licen[cs]e(?: ms pl)?
ms-rl | ms rl | microsoft reciprocal licen[cs]e(?: ms rl)?
osl-3.0 | osl 3 0 | (?:open software licen[cs]e|osl)~ 3(?: 0)?
osl-2.1 | osl 2 1 | (?:open software licen[cs]e|osl)~ 2 1
afl-2.1 | afl 2 1 | academic free licen[cs]e~ 2 1
afl-3.0 | afl 3 0 | academic free licen[cs]e~ 3(?: 0)?
qpl-1.0 | qpl 1 0 | q public licen[cs]e(?:~ 1(?: 0)?)?
sissl | sissl(?: 1 2)? | sun industry standards source licen[cs]e
apsl-1.0 | apsl 1 [012] | apple public source licen[cs]e~ 1(?: [012])?
apsl-2.0 | apsl 2 0 | apple public source licen[cs]e~ 2(?: 0)?
rpl-1.5 | rpl 1 5 | reciprocal public licen[cs]e(?:~ 1 5)?
ofl-1.0 | ofl 1 0(?: rfn| no rfn)? | (?:sil )?open font licen[cs]e~ 1 0
ofl-1.1 | ofl 1 1(?: rfn| no rfn)? | (?:sil )?open font licen[cs]e(?:~ 1 1)?
vim | vim | vim licen[cs]e
w3c | w3c(?: 19980720| 20150513)? | w3c software(?: notice)?(?: and document)?(?: notice and)? licen[cs]e
unicode-dfs | unicode dfs 201[56] | unicode(?: terms of use| data files and software licen[cs]e)
upl-1.0 | upl 1 0 | universal permissive licen[cs]e(?:~ 1(?: 0)?)?
ecl-2.0 | ecl 2 0 | educational community licen[cs]e(?:~ 2(?: 0)?)?
lppl-1.3 | lppl 1 3[ac]? | latex project public licen[cs]e(?:~ 1 3[ac]?)?
mulanpsl-2.0 | mulanpsl 2 0 | mulan psl(?: v2| 2)|mulan permissive software licen[cs]e
sspl-1.0 | sspl 1 0 | server side public licen[cs]e(?:~ 1(?: 0)?)?
busl-1.1 | busl 1 1 | business source licen[cs]e(?:~ 1 1)?
elastic-2.0 | elastic 2 0 | elastic licen[cs]e(?:~ 2(?: 0)?)?
commons-clause | - | commons clause(?: licen[cs]e condition)?
polyform-nc-1.0 | polyform noncommercial 1 0 0 | polyform noncommercial licen[cs]e
odbl-1.0 | odbl 1 0 | open database licen[cs]e(?: odbl)?(?:~ 1(?: 0)?)?
odc-by-1.0 | odc by 1 0 | (?:open data commons attribution|odc attribution|odc by) licen[cs]e(?:~ 1(?: 0)?)?
pddl-1.0 | pddl 1 0 | (?:open data commons )?public domain dedication and licen[cs]e
cdla-permissive-1.0 | cdla permissive 1 0 | community data licen[cs]e agreement permissive~ 1(?: 0)?
cdla-permissive-2.0 | cdla permissive 2 0 | community data licen[cs]e agreement permissive~ 2(?: 0)?
cdla-sharing-1.0 | cdla sharing 1 0 | community data licen[cs]e agreement sharing(?:~ 1(?: 0)?)?
ogl-uk-3.0 | ogl uk 3 0 | open government licen[cs]e(?:~ 3(?: 0)?)?
cecill-2.1 | cecill 2 1 | cecill(?: free software)? licen[cs]e(?: agreement)?~ 2 1
cecill | cecill (?:1 0|1 1|2 0|b|c) | cecill(?: [bc])? licen[cs]e
llama-2 | - | llama 2 community licen[cs]e(?: agreement)?
llama-3 | - | (?:meta )?llama 3(?: [123])? community licen[cs]e(?: agreement)?
openrail | - | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?
"""

#: Words of Creative Commons licenses: label, short words, long words.
COMMONS = r"""
cc-by | by | attribution
cc-by-sa | by sa | attribution share ?alike
cc-by-nd | by nd | attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-nc | by nc | attribution non ?commercial
cc-by-nc-sa | by nc sa | attribution non ?commercial share ?alike
cc-by-nc-nd | by nc nd | attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
"""
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: First sentences of license texts: label, words, keywords.
TEXTS = r"""
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files | hereby granted obtaining
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | notice substantial portions
mit | (?:the )?software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability | warranty merchantability
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | permission distribute hereby
bsd | redistribution and use in source and binary forms with or without modification are permitted provided that | redistribution binary permitted
bsd-3-clause | neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote products | neither contributors endorse
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment | advertising mentioning
apache-2.0 | you may not use this file except in compliance with the licen[cs]e | except compliance
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis | unless applicable writing
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e | redistribute modify gnu
gpl-2.0 | either version 2 of the licen[cs]e or at your option any later version | either option later
gpl-3.0 | either version 3 of the licen[cs]e or at your option any later version | either option later
gpl | this program is distributed in the hope that it will be useful but without any warranty | hope useful warranty
gpl | you should have received a copy of the gnu general public licen[cs]e along with this program | received gnu along
lgpl | you should have received a copy of the gnu lesser general public licen[cs]e along with this (?:library|program) | received gnu lesser
agpl | you should have received a copy of the gnu affero general public licen[cs]e along with this program | received gnu affero
gpl | gnu general public licen[cs]e version [123] (?:june|july|february) [0-9]+ | gnu public
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e | library redistribute gnu
mpl-1.1 | the contents of this file are subject to the mozilla public licen[cs]e version 1 1 | contents mozilla
mpl-2.0 | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0 | source mozilla
epl | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e | accompanying eclipse
cddl | the contents of this file are subject to the terms of the common development and distribution licen[cs]e | contents development
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable | warranty authors liable
zlib | altered source versions must be plainly marked as such and must not be misrepresented | altered plainly misrepresented
bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation | hereby organization obtaining
unlicense | this is free and unencumbered software released into the public domain | unencumbered domain
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed | everyone verbatim changing
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer | meet beer
ofl-1.1 | this font software is licen[cs]ed under the sil open font licen[cs]e version 1 1 | font sil
python-2.0 | this licen[cs]e agreement is between the python software foundation | python foundation agreement
artistic | the intent of this document is to state the conditions under which a package may be copied | intent conditions package
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e | granted gnu documentation
public-domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain | public domain
cc0-1.0 | the person who associated a work with this deed has dedicated the work to the public domain | deed domain
proprietary | all rights reserved(?: worldwide)? | rights reserved
proprietary | (?:proprietary and confidential|confidential and proprietary) | proprietary confidential
proprietary | unauthori[sz]ed copying of this file via any medium is strictly prohibited | copying medium prohibited
proprietary | may not be reproduced(?: [^ ]+){0,12} without (?:the )?(?:prior |express )?(?:written )?permission | reproduced without permission
noncommercial | (?:for|only for) (?:personal and |research and )?non ?commercial use only | use only
"""

#: Places of license texts on the web: label, words of the address, keyword.
URLS = r"""
apache-2.0 | (?:www )?apache org licen[cs]es licen[cs]e 2 0 | apache
apache-1.1 | (?:www )?apache org licen[cs]es licen[cs]e 1 1 | apache
mit | (?:www )?opensource org licen[cs]es mit(?: licen[cs]e)? | opensource
bsd-2-clause | (?:www )?opensource org licen[cs]es bsd 2 clause | opensource
bsd-3-clause | (?:www )?opensource org licen[cs]es bsd 3 clause | opensource
bsd | (?:www )?opensource org licen[cs]es bsd licen[cs]e | opensource
isc | (?:www )?opensource org licen[cs]es isc | opensource
zlib | (?:www )?(?:opensource org licen[cs]es zlib|zlib net zlib licen[cs]e) | zlib
gpl-2.0 | (?:www )?(?:gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0|opensource org licen[cs]es gpl 2 0) | gpl
gpl-3.0 | (?:www )?(?:gnu org licen[cs]es gpl 3 0|opensource org licen[cs]es gpl 3 0) | gpl
gpl | (?:www )?gnu org (?:copyleft|licen[cs]es) gpl | gnu
lgpl-2.1 | (?:www )?gnu org licen[cs]es (?:old licen[cs]es )?lgpl 2 1 | lgpl
lgpl-3.0 | (?:www )?gnu org licen[cs]es lgpl 3 0 | lgpl
agpl-3.0 | (?:www )?gnu org licen[cs]es agpl 3 0 | agpl
gfdl | (?:www )?gnu org (?:copyleft|licen[cs]es) fdl | gnu
mpl-1.1 | (?:www )?mozilla org mpl(?: mpl)? 1 1 | mozilla
mpl-2.0 | (?:www )?mozilla org mpl 2 0 | mozilla
epl-1.0 | (?:www )?eclipse org legal epl v10 | eclipse
epl-2.0 | (?:www )?eclipse org legal epl (?:v20|2 0) | eclipse
bsl-1.0 | (?:www )?boost org licen[cs]e 1 0 | boost
unlicense | (?:www )?unlicense org | unlicense
wtfpl | (?:www )?wtfpl net | wtfpl
ofl-1.1 | scripts sil org ofl | sil
cc0-1.0 | creativecommons org publicdomain zero 1 0 | creativecommons
public-domain | creativecommons org publicdomain mark 1 0 | creativecommons
odbl-1.0 | opendatacommons org licen[cs]es odbl | opendatacommons
odc-by-1.0 | opendatacommons org licen[cs]es by | opendatacommons
pddl-1.0 | opendatacommons org licen[cs]es pddl | opendatacommons
eupl-1.2 | joinup ec europa eu [^ ]+ eupl | eupl
artistic-2.0 | (?:www )?(?:perlfoundation org artistic licen[cs]e 2 0|opensource org licen[cs]es artistic 2 0) | artistic
"""

#: Words that tell of a license without naming one: label, words, keyword.
HINTS = r"""
unnamed | (?:see|read) (?:the )?(?:accompanying |attached |enclosed )?(?:file )?licen[cs]e(?: txt| md| file)? for (?:more )?(?:details|information|terms) | see
unnamed | licen[cs]e (?:agreement|terms) appl(?:y|ies) to | terms
unnamed | copyright (?:c )?[12][0-9]{3} | copyright
open-source | (?:an? )?open source licen[cs]e | source
creative-commons | (?:an? )?creative commons licen[cs]e | commons
"""


class Rule(NamedTuple):
    label: str
    kind: str
    #: Rank of the kind, 0 the highest.
    rank: int
    pattern: re.Pattern
    keywords: frozenset[str]


def _lines(table: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ")] for line in table.strip().splitlines()]


def _keywords(pattern: str) -> frozenset[str]:
    """Words that every match of a name has: those outside groups, alternatives and classes."""
    plain, depth, opened = "", 0, 0
    text = re.sub(r"\[[^\]]*\]| \?", "*", pattern)
    for i, c in enumerate(text):
        if c == "(":
            opened, depth = (i if not depth else opened), depth + 1
        elif c == ")":
            depth -= 1
            if not depth:
                # a group that starts with a space leaves the word before it whole
                plain += "" if re.match(r"\(\?[:!] ", text[opened:]) else "*"
        elif not depth:
            plain += c if c != "?" or text[i - 1] != ")" else ""
    return frozenset() if "|" in plain else frozenset(w for w in plain.split(" ") if w.isalnum() and not w.isdigit())


def _rule(label: str, kind: str, pattern: str, keywords: frozenset[str]) -> Rule:
    return Rule(label, kind, list(KINDS).index(kind), re.compile(rf"(?<= )(?:{pattern})(?= )"), keywords)


def build_rules() -> list[Rule]:
    """All rules, ordered by rank and within it as they are written."""
    rules = []
    for label, tag, name in _lines(NAMES):
        label = label.removesuffix("-short")
        name = name.replace("~", VERSION)
        if tag != "-":
            rules.append(_rule(label, "tag", rf"spdx licen[cs]e identifier {tag}", frozenset(["spdx", "identifier"])))
        rules.append(_rule(label, "notice", rf"{GRANT}(?:{name})", _keywords(name)))
        rules.append(_rule(label, "name", name, _keywords(name)))
    for label, short, long in _lines(COMMONS):
        for version in COMMONS_VERSIONS:
            number, own = version.replace(" ", "."), f"{label}-{version.replace(' ', '.')}"
            words = rf"(?:(?:cc|creative commons) {short}|creative commons {long}){LICENSE}{VERSION} {version}"
            rules.append(_rule(own, "tag", rf"spdx licen[cs]e identifier cc {short} {version}", frozenset(["spdx", "identifier"])))
            rules.append(_rule(own, "notice", rf"{GRANT}{words}", frozenset()))
            rules.append(_rule(own, "url", rf"creativecommons org licen[cs]es {short} {version}", frozenset(["creativecommons"])))
            rules.append(_rule(own, "name", words, frozenset()))
        rules.append(_rule(label, "name", rf"cc {short}|creative commons {long}{LICENSE}", frozenset()))
    rules.append(_rule("cc0-1.0", "tag", "spdx licen[cs]e identifier cc0 1 0", frozenset(["spdx", "identifier"])))
    rules.append(_rule("cc0-1.0", "notice", rf"{GRANT}(?:cc0|creative commons (?:zero|cc0))(?:{VERSION} 1 0)?", frozenset()))
    rules.append(_rule("cc0-1.0", "name", rf"cc0(?: 1 0)?|creative commons (?:zero|cc0)(?:{VERSION} 1 0)?", frozenset()))
    for kind, table in (("text", TEXTS), ("url", URLS), ("hint", HINTS)):
        for label, pattern, keywords in _lines(table):
            rules.append(_rule(label, kind, pattern, frozenset(keywords.split(" "))))
    return sorted(rules, key=lambda r: r.rank)


#: Words of which every match of every rule has one: rules without keywords of their own are tried where one is found.
ANY = (
    "license licence licenses licences licensed licenced relicensed spdx cc cc0 creative gpl gplv2 gpl2 gplv3 gpl3 lgpl agpl agplv3 "
    "gfdl mpl epl cddl eupl osl gnu bsd 0bsd unlicense wtfpl terms openrail rail mulan"
).split(" ")


class Scanner:
    """All rules with the automaton that finds their keywords."""

    def __init__(self):
        self.rules = build_rules()
        self.found = ahocorasick.Automaton()
        words = {w for r in self.rules for w in r.keywords} | set(ANY)
        for w in sorted(words):
            self.found.add_word(f" {w} ", w)
        self.found.make_automaton()
        self.any = frozenset(ANY)
        self.base = [(re.compile(rf"(?<= )(?={re.escape(phrase)} )"), label) for phrase, label in BASE.items()]
        self.base_words = [frozenset(phrase.split(" ")) for phrase in BASE]

    def matches(self, text: str) -> list[tuple[int, int, Rule]]:
        """Matches (start, end, rule) in a text of words, before overlaps are resolved; places are of characters."""
        seen = {word for _, word in self.found.iter(text)}
        if not seen:
            return []
        free = not self.any.isdisjoint(seen)
        return [
            (m.start(), m.end(), rule)
            for rule in self.rules
            if rule.keywords <= seen and (rule.keywords or free)
            for m in rule.pattern.finditer(text)
        ]


def resolved(matches: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Matches without those that lie inside another of higher rank, or of their own rank and longer or earlier in the rules."""
    kept, reach = [], {}
    for start, end, rule in sorted(matches, key=lambda m: (m[0], -m[1], m[2].rank)):
        if all(reach.get(rank, -1) < end for rank in range(rule.rank + 1)):
            kept.append((start, end, rule))
        reach[rule.rank] = max(reach.get(rule.rank, -1), end)
    return kept


def normal_texts(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Each text as lower-case words with a space before, between and behind them (one sign a byte), and its number of words."""
    data, offsets = A.text_bytes(texts)
    data = A.LOWER[data]
    found = A.words(data, offsets, A.LETTERS)
    lengths = found.ends - found.starts
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(at[-1]), 32, np.uint8)
    moved = np.repeat(at[:-1] - found.starts, lengths)
    inside = np.flatnonzero(A.LETTERS[data])
    out[inside + moved] = data[inside]
    joined = out.tobytes().decode("latin-1")
    bounds = at[found.of].tolist()
    return [" " + joined[a:b] for a, b in zip(bounds[:-1], bounds[1:])], np.diff(found.of)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Texts are lower-cased (A-Z) and read as words of letters, digits and
    characters beyond ASCII.  ``n_base`` counts the places of the phrases of
    ``BASE``, overlapping ones too, ``first_word`` and ``last_word`` are the
    least and largest word at which one starts.  ``labels`` has the labels of
    these and of all matches of the rules that are left after those inside
    others are taken out, ``spans`` the latter (label, kind, first word, words
    in it).  ``score`` is the largest confidence of what was found, 0 if
    nothing was.

    Cases: a NULL or empty text has no words and no labels (empty strings,
    NULL places); texts of any length are read whole, each by one task;
    repeated rows are scanned each; an empty table gives no rows; extra
    columns are ignored, whatever their names.
    """
    plain = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label: string, kind: string, first_word: long, words: long>>"
    )
    return plain.mapInArrow(_scanning, schema).withColumnRenamed("id", id)


_scanner: list[Scanner] = []

_SPANS = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))


def _scanning(batches):
    if not _scanner:
        _scanner.append(Scanner())
    scanner = _scanner[0]
    for part in A.chunks(batches, "text"):
        texts, counts = normal_texts(part.column("text"))
        rows = [scan_text(scanner, t) for t in texts]
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(counts, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )


def scan_text(scanner: Scanner, text: str) -> tuple:
    """(n_base, first_word, last_word, base_labels, labels, score, spans) of a text of words."""
    found = resolved(scanner.matches(text))
    base, first, last, labels = 0, None, None, set()
    for (pattern, label), phrase in zip(scanner.base, BASE):
        if f" {phrase} " not in text:
            continue
        places = [m.start() for m in pattern.finditer(text)]
        base += len(places)
        first = places[0] if first is None else min(first, places[0])
        last = places[-1] if last is None else max(last, places[-1])
        labels.add(label)
    # a place's word is the number of spaces before it, less the one in front
    marks = sorted({p for s, e, _ in found for p in (s, e)} | {p for p in (first, last) if p is not None})
    word, seen, at = {}, -1, 0
    for p in marks:
        seen += text.count(" ", at, p)
        word[p], at = seen, p
    spans = [{"label": r.label, "kind": r.kind, "first_word": word[s], "words": word[e] - word[s] + 1} for s, e, r in found]
    every = sorted(labels | {r.label for _, _, r in found})
    score = max([KINDS[r.kind] for _, _, r in found] + [KINDS["notice"]] * bool(labels), default=0.0)
    return base, word.get(first), word.get(last), ",".join(sorted(labels)), ",".join(every), score, spans
