"""License scans with ordered signature rules.

Every text is lower-cased (A-Z), cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ and joined by single
spaces, so rules are regular expressions over one normal form. Rules are written out by family (titles, notices
of source files by version, clauses of the texts, names) and ordered by priority: notices and clauses first, then names in
phrasings, from binding to loose, then titles. Licence expressions are read to their end, so "MIT OR Apache-2.0" has two
detections. A loose phrase beside a word such as "office" is none. Rules are gated: none is tried on a text without one of the general words, and a name's rules only where
its keyword occurs. A detection that lies inside a longer one, or has the
interval of one of higher priority, is suppressed. The three base phrases
are counted everywhere and their labels always stay.

Defined results: null and empty texts have no words and no labels; an empty table gives none. Repeated rows are scanned each
for itself. Of detections with one interval the rule of higher priority stays, so ties follow the order of the tables. Very long
texts are scanned whole, in time linear in their length and detections. Only the columns named are read, so others may have
any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import table

#: Phrase and label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, keyword that gates its rules and is in every match of them, name in normal form (a regular expression).
NAMES = (
    ("agpl-3", "affero", r"(?:gnu )?affero general public license(?: agpl)?(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl ?v?3(?: 0)?"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public license(?: lgpl)?(?: version| v)? ?3(?: 0)?"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: lgpl)?(?: version| v)? ?2 1"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?2 1"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("lgpl-2", "library", r"gnu library general public license(?: version| v)? ?2"),
    ("gpl-3", "general", r"gnu general public license(?: gpl)?(?: version| v)? ?3(?: 0)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?"),
    ("gpl-2", "general", r"gnu general public license(?: gpl)?(?: version| v)? ?2(?: 0)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?"),
    ("gpl", "general", r"gnu general public license"),
    ("gfdl", "documentation", r"gnu free documentation license(?: version \d(?: \d)?)?"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache software license(?: version| v)? ?1 1"),
    ("apache", "apache", r"apache software license"),
    ("mit-0", "mit", r"mit no attribution|mit 0"),
    ("mit", "mit", r"mit(?: x11)?"),
    ("mit", "expat", r"expat"),
    ("bsd-4", "bsd", r"bsd 4 clause|4 clause bsd|original bsd"),
    ("bsd-3", "bsd", r"bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd"),
    ("bsd-2", "bsd", r"bsd 2 clause|2 clause bsd|simplified bsd|freebsd"),
    ("bsd-0", "bsd", r"0bsd|zero clause bsd"),
    ("bsd", "bsd", r"bsd"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("mpl-2", "mozilla", r"mozilla public license(?: mpl)?(?: version| v)? ?2(?: 0)?"),
    ("mpl-2", "mpl", r"mpl ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: mpl)?(?: version| v)? ?1 1"),
    ("epl-2", "eclipse", r"eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("epl-2", "epl", r"epl 2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl-1", "epl", r"epl 1(?: 0)?"),
    ("eupl", "european", r"european union public licen[cs]e(?: v?1 [12])?"),
    ("cddl-1", "distribution", r"common development and distribution license(?: cddl)?(?: version)?(?: 1(?: [01])?)?"),
    ("boost-1", "boost", r"boost software license(?: version)?(?: 1(?: 0)?)?"),
    ("boost-1", "bsl", r"bsl 1 0"),
    ("artistic-2", "artistic", r"artistic license(?: version)? ?2(?: 0)?"),
    ("artistic-1", "artistic", r"artistic license(?: version)? ?1(?: 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "want to public", r"do what the fuck you want to public license"),
    ("psf-2", "python", r"python software foundation license(?: version 2)?"),
    ("psf-2", "psf", r"psf license"),
    ("ruby", "ruby", r"ruby license|ruby s license"),
    ("php-3", "php", r"php license(?: version)?(?: 3(?: 0?1)?)?"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("openssl", "openssl", r"openssl license"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-pl", "ms pl", r"ms pl"),
    ("ofl-1.1", "font", r"sil open font license(?: version)?(?: 1 [01])?"),
    ("odbl-1", "database", r"open (?:data commons )?(?:open )?database license(?: v?1(?: 0)?)?"),
    ("odc-by", "commons", r"open data commons attribution license"),
    ("cc0-1", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-sa", "by nc sa", r"cc by nc sa(?: \d(?: \d)?)?"),
    ("cc-by-nc-nd", "by nc nd", r"cc by nc nd(?: \d(?: \d)?)?"),
    ("cc-by-nc", "by nc", r"cc by nc(?: \d(?: \d)?)?"),
    ("cc-by-sa", "by sa", r"cc by sa(?: \d(?: \d)?)?"),
    ("cc-by-nd", "by nd", r"cc by nd(?: \d(?: \d)?)?"),
    ("cc-by", "cc by", r"cc by(?: \d(?: \d)?)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: \d(?: \d)?)?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: \d(?: \d)?)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: \d(?: \d)?)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: \d(?: \d)?)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s(?: \d(?: \d)?)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: \d(?: \d)?)?"),
)
#: Phrasing around a name, and how sure a detection by it is.
PHRASINGS = (
    (r"spdx license identifier {}(?: only| or later)?", 0.99),
    (r"(?:licen[cs]ed|released|distributed|published|provided|available|redistributed|relicensed)(?: to you)? under(?: the(?: terms(?: and conditions)? of)?)?(?: the)? {}(?: licen[cs]e)?", 0.95),
    (r"subject to the(?: terms(?: and conditions)? of)?(?: the)? {}(?: licen[cs]e)?", 0.9),
    (r"(?:under|governed by|covered by) (?:the )?(?:terms of (?:the )?)?{} licen[cs]es?", 0.85),
    (r"licen[cs]e (?:is |type |name )?{}", 0.75),
    (r"{} licen[cs]e(?:d| text| agreement| terms)?", 0.7),
)
#: Rules whose label needs no name; keyword, label, expression, how sure.
OTHERS = (
    ("permission", "mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 0.97),
    ("permission", "isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.97),
    ("redistribution", "bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("gnu", "gpl", r"you can redistribute it and or modify it under the terms of the gnu general public license", 0.96),
    ("public domain", "public-domain", r"(?:dedicated to|released into|placed in|in) the public domain", 0.8),
    ("rights reserved", "proprietary", r"all rights reserved", 0.5),
    ("proprietary", "proprietary", r"proprietary and confidential", 0.6),
)
#: Rules written out by family. Titles of licences, as files named LICENSE begin; keyword, label, expression, how sure.
TITLES = (
    ("affero", "agpl-3", r"gnu affero general public license version 3(?: 19 november 2007)?", 0.9),
    ("affero", "agpl", r"gnu affero general public license", 0.7),
    ("lesser", "lgpl-3", r"gnu lesser general public license version 3(?: 29 june 2007)?", 0.9),
    ("lesser", "lgpl-2.1", r"gnu lesser general public license version 2 1(?: february 1999)?", 0.9),
    ("lesser", "lgpl", r"gnu lesser general public license", 0.7),
    ("library", "lgpl-2", r"gnu library general public license version 2(?: june 1991)?", 0.9),
    ("general", "gpl-3", r"gnu general public license version 3(?: 29 june 2007)?", 0.9),
    ("general", "gpl-2", r"gnu general public license version 2(?: june 1991)?", 0.9),
    ("general", "gpl-1", r"gnu general public license version 1(?: february 1989)?", 0.9),
    ("general", "gpl", r"gnu general public license", 0.7),
    ("documentation", "gfdl", r"gnu free documentation license(?: version 1 [123])?", 0.85),
    ("apache", "apache-2", r"apache license version 2 0(?: january 2004)?", 0.95),
    ("apache", "apache-1.1", r"apache software license version 1 1", 0.9),
    ("mozilla", "mpl-2", r"mozilla public license version 2 0", 0.9),
    ("mozilla", "mpl-1.1", r"mozilla public license version 1 1", 0.9),
    ("mozilla", "mpl-1", r"mozilla public license version 1 0", 0.9),
    ("mozilla", "mpl", r"mozilla public license", 0.65),
    ("eclipse", "epl-2", r"eclipse public license v 2 0", 0.9),
    ("eclipse", "epl-1", r"eclipse public license v 1 0", 0.9),
    ("eclipse", "epl", r"eclipse public license", 0.65),
    ("european", "eupl", r"european union public licence(?: v 1 [12])?", 0.85),
    ("distribution", "cddl-1", r"common development and distribution license(?: cddl)? version 1 [01]", 0.9),
    ("common public", "cpl-1", r"common public license version 1 0", 0.9),
    ("ibm", "ipl-1", r"ibm public license version 1 0", 0.9),
    ("boost", "boost-1", r"boost software license version 1 0(?: august 17th 2003)?", 0.95),
    ("artistic", "artistic-2", r"the artistic license 2 0", 0.9),
    ("artistic", "artistic-1", r"the clarified artistic license", 0.8),
    ("academic", "afl-3", r"academic free license(?: afl)? v(?:ersion)? 3 0", 0.9),
    ("open software", "osl-3", r"open software license(?: osl)? v(?:ersion)? 3 0", 0.9),
    ("microsoft", "ms-pl", r"microsoft public license ms pl", 0.9),
    ("microsoft", "ms-rl", r"microsoft reciprocal license(?: ms rl)?", 0.9),
    ("python", "psf-2", r"python software foundation license version 2", 0.9),
    ("font", "ofl-1.1", r"sil open font license version 1 1(?: 26 february 2007)?", 0.9),
    ("creative commons", "cc0-1", r"creative commons cc0 1 0 universal", 0.9),
    ("creative commons", "cc-by", r"creative commons attribution 4 0 international(?: public license)?", 0.9),
    ("creative commons", "cc-by-sa", r"creative commons attribution sharealike 4 0 international(?: public license)?", 0.9),
    ("creative commons", "cc-by-nc", r"creative commons attribution noncommercial 4 0 international(?: public license)?", 0.9),
    ("server side", "sspl-1", r"server side public license(?: version 1)?", 0.9),
    ("business source", "busl-1.1", r"business source license(?: 1 1)?", 0.85),
    ("elastic", "elastic-2", r"elastic license 2 0", 0.9),
    ("do what the fuck", "wtfpl", r"do what the fuck you want to public license version 2(?: december 2004)?", 0.9),
    ("mulan", "mulan-2", r"mulan permissive software license version 2", 0.9),
    ("blue oak", "blueoak-1", r"blue oak model license(?: version 1 0 0)?", 0.9),
    ("upl", "upl-1", r"universal permissive license upl version 1 0", 0.9),
    ("zope", "zpl-2.1", r"zope public license(?: zpl)? version 2 1", 0.9),
    ("latex", "lppl-1.3", r"latex project public license(?: version 1 3[abc]?)?", 0.85),
    ("isc license", "isc", r"isc license", 0.7),
    ("mit license", "mit", r"the mit license(?: mit)?", 0.8),
)
#: Notices at the head of source files, by version.
NOTICES = (
    ("affero", "agpl-3", r"(?:you can redistribute it and or modify it under the terms of the )?gnu affero general public license as published by the free software foundation either version 3 of the license(?: or at your option any later version)?", 0.98),
    ("lesser", "lgpl-3", r"(?:you can redistribute it and or modify it under the terms of the )?gnu lesser general public license as published by the free software foundation either version 3 of the license(?: or at your option any later version)?", 0.98),
    ("lesser", "lgpl-2.1", r"(?:you can redistribute it and or modify it under the terms of the )?gnu lesser general public license as published by the free software foundation either version 2 1 of the license(?: or at your option any later version)?", 0.98),
    ("library", "lgpl-2", r"(?:you can redistribute it and or modify it under the terms of the )?gnu library general public license as published by the free software foundation either version 2 of the license(?: or at your option any later version)?", 0.98),
    ("general", "gpl-3", r"(?:you can redistribute it and or modify it under the terms of the )?gnu general public license as published by the free software foundation either version 3 of the license(?: or at your option any later version)?", 0.98),
    ("general", "gpl-2", r"(?:you can redistribute it and or modify it under the terms of the )?gnu general public license as published by the free software foundation either version 2 of the license(?: or at your option any later version)?", 0.98),
    ("general", "gpl-1", r"(?:you can redistribute it and or modify it under the terms of the )?gnu general public license as published by the free software foundation either version 1(?: of the license)?(?: or at your option any later version)?", 0.98),
    ("general", "gpl-3", r"(?:you can redistribute it and or modify it under the terms of the )?gnu general public license version 3 as published by the free software foundation", 0.98),
    ("general", "gpl-2", r"(?:you can redistribute it and or modify it under the terms of the )?gnu general public license version 2 as published by the free software foundation", 0.98),
    ("lesser", "lgpl-2.1", r"(?:you can redistribute it and or modify it under the terms of the )?gnu lesser general public license version 2 1 as published by the free software foundation", 0.98),
    ("free software", "gpl-3", r"free software foundation either version 3 of the license or at your option any later version", 0.9),
    ("free software", "gpl-2", r"free software foundation either version 2 of the license or at your option any later version", 0.9),
    ("apache", "apache-2", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 0.99),
    ("apache", "apache-2", r"you may obtain a copy of the license at http(?:s)? www apache org licenses license 2 0", 0.98),
    ("apache", "apache-2", r"licensed to the apache software foundation asf under one or more contributor license agreements", 0.95),
    ("mozilla", "mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0.99),
    ("mozilla", "mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", 0.99),
    ("eclipse", "epl-2", r"made available under the terms of the eclipse public license (?:v )?2 0", 0.98),
    ("eclipse", "epl-1", r"made available under the terms of the eclipse public license (?:v )?1 0", 0.98),
    ("boost", "boost-1", r"distributed under the boost software license version 1 0", 0.99),
    ("distribution", "cddl-1", r"the contents of this file are subject to the terms of the common development and distribution license", 0.97),
    ("bsd style", "bsd", r"governed by a bsd style license that can be found in the license file", 0.95),
    ("mit style", "mit", r"governed by an mit style license that can be found in the license file", 0.95),
    ("same terms", "perl", r"free software you can redistribute it and or modify it under the same terms as perl(?: itself)?", 0.95),
    ("eupl", "eupl", r"licensed under the eupl version 1 [12]", 0.95),
    ("european", "eupl", r"european union public licence the licence you may not use this work except in compliance", 0.95),
)
#: Sentences of the licences themselves.
CLAUSES = (
    ("redistributions", "bsd", r"redistributions of source code must retain the above copyright notice", 0.9),
    ("redistributions", "bsd", r"redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("endorse", "bsd-3", r"names? of (?:its|the|any)(?: contributors| copyright holders?)? (?:nor the names of its contributors )?may (?:not )?be used to endorse or promote products derived from this software", 0.92),
    ("advertising materials", "bsd-4", r"all advertising materials mentioning features or use of this software must display the following acknowledgement", 0.95),
    ("merchantability", "mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.85),
    ("substantial portions", "mit", r"permission notice shall be included in all copies or substantial portions of the software", 0.93),
    ("permission", "isc", r"permission notice appear in all copies", 0.8),
    ("author disclaims", "isc", r"the software is provided as is and the author disclaims all warranties with regard to this software", 0.9),
    ("altered source", "zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.97),
    ("misrepresented", "zlib", r"the origin of this software must not be misrepresented", 0.95),
    ("unencumbered", "unlicense", r"this is free and unencumbered software released into the public domain", 0.98),
    ("anyone is free", "unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.95),
    ("waive", "cc0-1", r"waive all copyright and related or neighboring rights", 0.85),
    ("perpetual", "apache-2", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 0.95),
    ("copyleft", "gpl-3", r"is a free copyleft license for software and other kinds of works", 0.95),
    ("network server", "agpl-3", r"specifically designed to ensure cooperation with the community in the case of network server software", 0.97),
    ("freedom to share", "gpl-2", r"the licenses for most software are designed to take away your freedom to share and change it", 0.9),
    ("world wide", "mpl-2", r"each contributor hereby grants you a world wide royalty free non exclusive license under intellectual property rights", 0.9),
    ("accompanying documentation", "boost-1", r"obtaining a copy of the software and accompanying documentation covered by this license", 0.9),
    ("reserved font name", "ofl-1.1", r"reserved font names?", 0.7),
    ("you just do", "wtfpl", r"you just do what the fuck you want to", 0.95),
    ("buy me a beer", "beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return", 0.97),
    ("good not evil", "json", r"the software shall be used for good not evil", 0.98),
    ("licensed rights", "cc-by-nc", r"the licensed rights are limited to non ?commercial purposes only", 0.7),
    ("may be reproduced", "proprietary", r"no part of this (?:software|document|publication|work) may be reproduced(?: distributed)?(?: or transmitted)?", 0.6),
    ("trade secrets", "proprietary", r"contains (?:confidential information and )?trade secrets", 0.6),
    ("copying of this file", "proprietary", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited", 0.9),
)
#: Identifiers of licence expressions in normal form.
IDENTIFIERS = {
    "mit": "mit", "mit 0": "mit-0", "isc": "isc", "zlib": "zlib", "0bsd": "bsd-0", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "bsd 4 clause": "bsd-4", "bsd 2 clause patent": "bsd-2", "bsd 3 clause clear": "bsd-3",
    "apache 1 0": "apache-1", "apache 1 1": "apache-1.1", "apache 2 0": "apache-2", "gpl 1 0": "gpl-1", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 0": "lgpl-2", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 1 0": "agpl-1", "agpl 3 0": "agpl-3",
    "gfdl 1 1": "gfdl", "gfdl 1 2": "gfdl", "gfdl 1 3": "gfdl", "mpl 1 0": "mpl-1", "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2", "epl 1 0": "epl-1", "epl 2 0": "epl-2", "eupl 1 1": "eupl", "eupl 1 2": "eupl", "cddl 1 0": "cddl-1", "cddl 1 1": "cddl-1",
    "cpl 1 0": "cpl-1", "ipl 1 0": "ipl-1", "bsl 1 0": "boost-1", "busl 1 1": "busl-1.1", "artistic 1 0": "artistic-1", "artistic 2 0": "artistic-2", "afl 3 0": "afl-3", "osl 3 0": "osl-3", "ms pl": "ms-pl", "ms rl": "ms-rl", "psf 2 0": "psf-2",
    "python 2 0": "psf-2", "ruby": "ruby", "php 3 0": "php-3", "php 3 01": "php-3", "postgresql": "postgresql", "openssl": "openssl", "ofl 1 1": "ofl-1.1", "unlicense": "unlicense", "wtfpl": "wtfpl", "cc0 1 0": "cc0-1", "cc by 3 0": "cc-by", "cc by 4 0": "cc-by",
    "cc by sa 3 0": "cc-by-sa", "cc by sa 4 0": "cc-by-sa", "cc by nd 4 0": "cc-by-nd", "cc by nc 4 0": "cc-by-nc", "cc by nc sa 4 0": "cc-by-nc-sa", "cc by nc nd 4 0": "cc-by-nc-nd", "odbl 1 0": "odbl-1", "sspl 1 0": "sspl-1", "elastic 2 0": "elastic-2",
    "upl 1 0": "upl-1", "zpl 2 1": "zpl-2.1", "lppl 1 3c": "lppl-1.3", "mulanpsl 2 0": "mulan-2", "blueoak 1 0 0": "blueoak-1", "x11": "mit", "ncsa": "ncsa", "beerware": "beerware", "json": "json",
}
#: Identifiers that are no words of a language, so they count without a header; and what may follow "with".
ALONE = re.compile(r"(?<= )(?:(?:a|l)?gpl [123] [01] (?:only|or later)|bsd [234] clause|apache 2 0|mpl [12] [01]|cc0 1 0|epl [12] 0|eupl 1 [12]|cddl 1 [01]|0bsd)(?= )".encode())
EXCEPTIONS = ("classpath exception 2 0", "gcc exception 3 1", "llvm exception", "autoconf exception 3 0", "bison exception 2 2", "font exception 2 0", "linux syscall note", "openssl exception")
HEADER = b" spdx license identifier "
#: Words beside a weak detection that make it something else than a licence of software.
NEXT_WORDS = frozenset(b"office offices plate plates holder holders number numbers fee fees key keys server servers exam exams department bureau centre center test tests".split())
LAST_WORDS = frozenset(b"in at from near".split())
WEAK = 0.75
GENERAL = (b"licen", b"spdx", b" under ", b"subject to", b"governed by", b"covered by", b"permission", b"redistribution", b"public domain", b"rights reserved", b"proprietary", b"cc by", b"cc0", b"creative commons", b"gpl ", b"bsd ", b"apache ", b"mpl ", b"epl ", b"eupl ", b"cddl ", b"endorse", b"advertising materials", b"merchantability", b"disclaims", b"altered source", b"misrepresented",
    b"unencumbered", b"anyone is free", b"waive", b"reserved font", b"you just do", b"buy me a beer", b"good not evil", b"may be reproduced", b"trade secrets", b"same terms", b"free software", b"network server", b"copying of this file")


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    sure: float


def rules() -> list[Rule]:
    """All rules, by priority: full legal texts first, then by phrasing and by name, in the order above."""
    made = [Rule(label, k.encode(), re.compile(rf"(?<= )(?:{x})(?= )".encode()), sure) for k, label, x, sure in (*NOTICES, *OTHERS, *CLAUSES)]
    for phrase, sure in PHRASINGS:
        made += [Rule(label, k.encode(), re.compile(rf"(?<= )(?:{phrase.format(f'(?:{name})')})(?= )".encode()), sure) for label, k, name in NAMES]
    made += [Rule(label, k.encode(), re.compile(rf"(?<= )(?:{x})(?= )".encode()), sure) for k, label, x, sure in TITLES]
    made += [Rule(label, k.encode(), re.compile(rf"(?<= )(?:{name})(?= )".encode()), 0.6) for label, k, name in NAMES if label.startswith("cc")]
    return made


#: Bytes to a normal form: A-Z to a-z; separators to a space; digits, a-z and bytes above 7F stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


@dataclass(frozen=True)
class Detection:
    start: int  # words
    end: int
    label: str
    sure: float
    priority: int


def spaces_before(normal: bytes) -> Callable[[int], int]:
    """How many spaces stand before a byte: by binary search over their places, which are listed at the first call."""
    places: list[np.ndarray] = []

    def count(at: int) -> int:
        if not places:
            places.append(np.flatnonzero(np.frombuffer(normal, np.uint8) == 32))
        return int(places[0].searchsorted(at))

    return count


def base_places(normal: bytes) -> list[Detection]:
    """Every place of every base phrase in ' words joined ', overlapping ones too."""
    found, before = [], spaces_before(normal)
    for k, (phrase, label) in enumerate(BASE):
        probe = f" {phrase} ".encode()
        at = normal.find(probe)
        while at >= 0:
            first = before(at)
            found.append(Detection(first, first + phrase.count(" ") + 1, label, 1.0, k - len(BASE)))
            at = normal.find(probe, at + 1)
    return found


def identifier_at(words: list[str], at: int) -> tuple[int, str] | None:
    """The end and the label of the longest identifier at a word, with what limits its version."""
    for n in range(min(6, len(words) - at), 0, -1):
        label = IDENTIFIERS.get(" ".join(words[at : at + n]))
        if label:
            end = at + n
            after = words[end : end + 2]
            return end + (1 if after[:1] == ["only"] else 2 if after == ["or", "later"] else 0), label
    return None


def expressions(normal: bytes) -> list[Detection]:
    """The licences of "SPDX-License-Identifier: A OR B AND C WITH exception", each a detection; and identifiers that stand alone.

    The first takes in the header, so intervals of one expression lie side by side and none suppresses another.
    """
    found, before = [], spaces_before(normal)
    at = normal.find(HEADER)
    while at >= 0:
        first = before(at)
        words = normal[at + len(HEADER) : at + len(HEADER) + 2000].decode("utf-8", "replace").split()
        start, k = first, 0
        while (got := identifier_at(words, k)) is not None:
            k = got[0]
            found.append(Detection(start, first + 3 + k, got[1], 0.99, -1))
            if words[k : k + 1] == ["with"]:
                k += 1 + next((x.count(" ") + 1 for x in EXCEPTIONS if words[k + 1 : k + 2 + x.count(" ")] == x.split()), 0)
            if words[k : k + 1] not in (["and"], ["or"]):
                break
            start, k = first + 3 + k, k + 1
        at = normal.find(HEADER, at + 1)
    for m in ALONE.finditer(normal):
        first, text = before(m.start()) - 1, m[0].decode()
        label = IDENTIFIERS.get(text.removesuffix(" only").removesuffix(" or later"))
        if label:
            found.append(Detection(first, first + text.count(" ") + 1, label, 0.7, 10**6))
    return found


def _about_something_else(normal: bytes, m: re.Match) -> bool:
    before, after = normal[max(0, m.start() - 40) : m.start()].split(), normal[m.end() : m.end() + 40].split()
    return bool(before and before[-1] in LAST_WORDS or after and after[0] in NEXT_WORDS)


def detections(normal: bytes, ordered: list[Rule]) -> list[Detection]:
    """What the gated rules find; suppress() decides between them."""
    if not any(word in normal for word in GENERAL):
        return []
    gates: dict[bytes, bool] = {}
    found, before = expressions(normal), spaces_before(normal)
    for k, rule in enumerate(ordered):
        if gates.setdefault(rule.keyword, rule.keyword in normal):
            for m in rule.pattern.finditer(normal):
                if rule.sure <= WEAK and _about_something_else(normal, m):
                    continue
                first = before(m.start()) - 1
                found.append(Detection(first, first + m[0].count(b" ") + 1, rule.label, rule.sure, k))
    return found


def suppress(found: list[Detection]) -> list[Detection]:
    """Drops what lies inside a longer detection, or shares the interval of one of higher priority.

    Sweeps by start, longest first, so only intervals still open can contain the next one.
    """
    kept: list[Detection] = []
    open_: list[Detection] = []
    for d in sorted(found, key=lambda d: (d.start, -d.end, d.priority)):
        open_ = [o for o in open_ if o.end > d.start]
        if not any(o.end >= d.end for o in open_):
            kept.append(d)
            open_.append(d)
    return kept


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    score is how sure the surest detection is, 0 without any. detections: label:start:end in words, by start.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = rules()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = normalise(text)
                normal = b" " + b" ".join(words) + b" "
                base = base_places(normal)
                kept = suppress(base + detections(normal, ordered))
                starts = [d.start for d in base]
                every = sorted({*base, *kept}, key=lambda d: (d.start, d.end, d.label))
                rows.append((
                    len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({d.label for d in base})),
                    ",".join(sorted({d.label for d in every})), max((d.sure for d in every), default=0.0), ",".join(f"{d.label}:{d.start}:{d.end}" for d in every),
                ))
            if rows:
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
                cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
