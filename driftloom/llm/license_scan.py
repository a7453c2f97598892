"""License scans: ordered signature rules behind a keyword filter.

Every rule is a regular expression with a label, a priority and a keyword; tags, fields and short notices are read
by the grammar of license expressions, and only identifiers of a known list are labels there. A text is searched once for all keywords; only the rules of keywords that occur are tried. Of overlapping detections the
one of higher priority stays, then the longer one: a detection inside a kept one is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_text_columns

#: Between words, and what words consist of, in bytes of UTF-8 with A-Z lowered.
GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
IN_WORD = rb"[0-9a-z\x80-\xff]"
#: Phrases that are labelled wherever their words stand consecutively (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Licenses: label, names as running text, versions with labels of their own, page that holds the terms
#: (fixed values). A name without a version has the label alone, with version 2.0 also -2.0, and so on.
LICENSES = [
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl", "agplv3"], "1.0 3.0", "gnu.org/licenses/agpl"),
    ("apache", ["apache license", "apache software license", "apache public license"], "1.0 1.1 2.0", "apache.org/licenses/license"),
    ("artistic", ["artistic license", "perl artistic license"], "1.0 2.0", "perlfoundation.org/artistic-license"),
    ("bsd", ["bsd license", "bsd style license", "berkeley software distribution license"], "", "opensource.org/licenses/bsd-license"),
    ("bsd-2-clause", ["simplified bsd license", "2 clause bsd", "two clause bsd", "bsd 2 clause", "freebsd license"], "", "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", ["new bsd license", "3 clause bsd", "three clause bsd", "bsd 3 clause", "revised bsd license", "modified bsd license"], "", "opensource.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", ["original bsd license", "4 clause bsd", "bsd 4 clause"], "", "spdx.org/licenses/bsd-4-clause"),
    ("bsl", ["boost software license"], "1.0", "boost.org/license"),
    ("busl", ["business source license"], "1.1", "mariadb.com/bsl"),
    ("cc-by", ["creative commons attribution", "cc by"], "2.0 2.5 3.0 4.0", "creativecommons.org/licenses/by/"),
    ("cc-by-nc", ["creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"], "2.0 2.5 3.0 4.0", "creativecommons.org/licenses/by-nc/"),
    ("cc-by-nc-nd", ["creative commons attribution noncommercial noderivs", "creative commons attribution noncommercial noderivatives", "cc by nc nd"], "2.0 2.5 3.0 4.0", "creativecommons.org/licenses/by-nc-nd/"),
    ("cc-by-nc-sa", ["creative commons attribution noncommercial sharealike", "cc by nc sa"], "2.0 2.5 3.0 4.0", "creativecommons.org/licenses/by-nc-sa/"),
    ("cc-by-nd", ["creative commons attribution noderivs", "creative commons attribution noderivatives", "cc by nd"], "2.0 2.5 3.0 4.0", "creativecommons.org/licenses/by-nd/"),
    ("cc-by-sa", ["creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"], "2.0 2.5 3.0 4.0", "creativecommons.org/licenses/by-sa/"),
    ("cc0", ["creative commons zero", "cc0"], "1.0", "creativecommons.org/publicdomain/zero/"),
    ("cddl", ["common development and distribution license", "cddl"], "1.0 1.1", "opensource.org/licenses/cddl"),
    ("cecill", ["cecill license", "cecill free software license"], "1.0 2.0 2.1", "cecill.info/licences"),
    ("cpl", ["common public license"], "1.0", "opensource.org/licenses/cpl"),
    ("ecl", ["educational community license"], "1.0 2.0", "opensource.org/licenses/ecl"),
    ("elastic", ["elastic license"], "1.0 2.0", "elastic.co/licensing/elastic-license"),
    ("epl", ["eclipse public license"], "1.0 2.0", "eclipse.org/legal/epl"),
    ("eupl", ["european union public licence", "european union public license"], "1.0 1.1 1.2", "joinup.ec.europa.eu/collection/eupl"),
    ("gfdl", ["gnu free documentation license", "gfdl"], "1.1 1.2 1.3", "gnu.org/licenses/fdl"),
    ("gpl", ["gnu general public license", "gnu gpl", "gnu public license", "gpl", "gplv1", "gplv2", "gplv3"], "1.0 2.0 3.0", "gnu.org/licenses/gpl"),
    ("isc", ["isc license"], "", "opensource.org/licenses/isc"),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "lesser general public license", "gnu lgpl", "lgpl", "lgplv2", "lgplv3"], "2.0 2.1 3.0", "gnu.org/licenses/lgpl"),
    ("lppl", ["latex project public license"], "1.0 1.1 1.2 1.3", "latex-project.org/lppl"),
    ("mit", ["mit license", "mit licence", "expat license", "x11 license"], "", "opensource.org/licenses/mit"),
    ("mpl", ["mozilla public license", "mpl"], "1.0 1.1 2.0", "mozilla.org/mpl"),
    ("ms-pl", ["microsoft public license"], "", "opensource.org/licenses/ms-pl"),
    ("ms-rl", ["microsoft reciprocal license"], "", "opensource.org/licenses/ms-rl"),
    ("ncsa", ["university of illinois ncsa open source license"], "", "opensource.org/licenses/ncsa"),
    ("odbl", ["open database license"], "1.0", "opendatacommons.org/licenses/odbl"),
    ("ofl", ["sil open font license"], "1.0 1.1", "scripts.sil.org/ofl"),
    ("osl", ["open software license"], "1.0 2.0 2.1 3.0", "opensource.org/licenses/osl"),
    ("php", ["php license"], "3.0 3.01", "php.net/license"),
    ("polyform-nc", ["polyform noncommercial license"], "1.0.0", "polyformproject.org/licenses/noncommercial"),
    ("postgresql", ["postgresql licence", "postgresql license"], "", "opensource.org/licenses/postgresql"),
    ("psf", ["python software foundation license"], "2", "docs.python.org/3/license"),
    ("public-domain", ["dedicated to the public domain", "released into the public domain", "placed in the public domain"], "", "wiki.creativecommons.org/wiki/public_domain"),
    ("sspl", ["server side public license"], "1", "mongodb.com/licensing/server-side-public-license"),
    ("unlicense", ["this is free and unencumbered software", "the unlicense"], "", "unlicense.org"),
    ("upl", ["universal permissive license"], "1.0", "opensource.org/licenses/upl"),
    ("w3c", ["w3c software notice and license", "w3c software license"], "", "w3.org/consortium/legal/copyright-software"),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], "", "wtfpl.net"),
    ("zlib", ["zlib license", "zlib libpng license"], "", "opensource.org/licenses/zlib"),
    ("zpl", ["zope public license"], "1.1 2.0 2.1", "opensource.org/licenses/zpl"),
]
#: Sentences of license texts and notices, as their words stand: label, words (fixed values).
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0", "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0", "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("artistic-2.0", "you are permitted to use the standard version and create and use modified versions for any purpose without restriction provided that you do not distribute the modified version"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mit", "permission is hereby granted to any person obtaining a copy of this software to deal in the software without restriction"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "use of this source code is governed by an mit style license"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", "use of this source code is governed by a bsd style license"),
    ("bsd", "this software is provided by the regents and contributors as is"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("bsd-3-clause", "neither the name of the university nor the names of its contributors may be used"),
    ("bsd-4-clause", "this product includes software developed by the university of california berkeley and its contributors"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledgment"),
    ("gpl", "either version 2 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2.0", "the precise terms and conditions for copying distribution and modification follow gnu general public license terms and conditions"),
    ("gpl-2.0", "you may copy and distribute verbatim copies of the program s source code as you receive it"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "if you convey a covered work knowingly relying on a patent license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.1", "a work that uses the library in object code form may be distributed under the terms of this license"),
    ("agpl-3.0", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-2.0", "this source code may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public license"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", "this software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("artistic", "you may make and give away verbatim copies of the source form of the standard version of this package without restriction"),
    ("ofl-1.1", "the ofl allows the licensed fonts to be used studied modified and redistributed freely as long as they are not sold by themselves"),
    ("ofl-1.1", "no modified version of the font software may use the reserved font name"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("psf", "subject to the terms and conditions of this license agreement psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php", "this product includes php software freely available from"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("polyform-nc", "any noncommercial purpose is a permitted purpose"),
    ("odbl-1.0", "this database is made available under the open database license"),
    ("eupl", "licensed under the eupl"),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("hpnd", "that the name of the copyright holders not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("public-domain", "this work has been released into the public domain by its author"),
    ("public-domain", "no copyright is claimed and the work is in the public domain"),
    ("public-domain", "this file is in the public domain"),
    ("proprietary", "this software is the confidential and proprietary information of"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "you shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement"),
    ("proprietary", "reproduction or redistribution in whole or in part is prohibited without the prior written consent"),
    ("proprietary", "no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
]
#: What stands around a name: how certain that makes it (0 to 100), before it, after it (fixed values).
FRAMES = [
    (94, rb"(?:licen[sc]ed|released|distributed|published|available|provided)\s+under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?", rb""),
    (88, rb"subject\s+to\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?", rb""),
    (84, rb"(?:a\s+copy|copies)\s+of\s+the\s+", rb""),
    (70, rb"see\s+(?:the\s+)?", rb"\s+for\s+(?:more\s+)?details"),
    (60, rb"", rb""),
]
#: Between a name and its version, and what may follow that.
VERSION = rb"(?:[\s,(-]+(?:version|v\.?)?\s*|v)"
LATER = rb"(?:\s+or\s+(?:any\s+)?later)?"
#: Words of many names, which tell little when they occur.
COMMON = frozenset("license licence public software general free open source the this is and".split())


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern
    base: bool = False


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    label: str
    priority: int
    base: bool


def spaced(name: str) -> bytes:
    return (rb"(?<!" + IN_WORD + rb")") + GAP.join(re.escape(w.encode()) for w in name.split()) + rb"(?!" + IN_WORD + rb")"


def telling(name: str) -> str:
    """The word of a name that occurs least for other reasons: the longest that is not common, if it is
    not short; short words are parts of many others."""
    words = name.split()
    return max([w for w in words if w not in COMMON and len(w) >= 5] or words, key=len)


def versions(label: str, known: str) -> list[tuple[str, bytes]]:
    """(label, how the version is written): 2.0 also as 2, as long as no other known version begins so."""
    out = []
    for v in known.split():
        short = v.removesuffix(".0")
        shape = re.escape(short.encode()) + (rb"(?:\.0)?" if short != v else rb"")
        out.append((f"{label}-{v}", shape + rb"(?![0-9]|\.[0-9])"))
    return out


def rule_table() -> list[Rule]:
    """The base phrases; every license by its page, and its names, with each version and without, in every
    frame; and the sentences of texts and notices."""
    rules = [Rule(label, 50, max(p.split(), key=len), re.compile(spaced(p)), True) for p, label in PHRASES.items()]
    rules += [Rule(label, 97, telling(sentence), re.compile(spaced(sentence))) for label, sentence in SENTENCES]
    for label, names, known, page in LICENSES:
        rules.append(Rule(label, 98, page, re.compile(re.escape(page.encode()))))
        for v in known.split():  # a page that names its version: license-2.0, by/4.0/, license_1_0, bsl11
            digits = rb"[._-]?".join(re.escape(x.encode()) for x in v.split("."))
            rules.append(Rule(f"{label}-{v}", 99, page, re.compile(re.escape(page.encode()) + rb"[/_v-]*" + digits + rb"(?![0-9]|\.[0-9])")))
        for name in names:
            own, glued = name, ""
            if m := re.fullmatch(r"(.*[a-z])v(\d)", name):
                own, glued = m[1], f"{label}-{m[2]}.0"
            for priority, before, after in FRAMES:
                if glued:
                    rules.append(Rule(glued, priority + 1, name, re.compile(before + spaced(name) + LATER + after)))
                    continue
                rules.append(Rule(label, priority, telling(name), re.compile(before + spaced(own) + after)))
                rules += [Rule(one, priority + 1, telling(name), re.compile(before + spaced(own)[: -len(rb"(?!" + IN_WORD + rb")")] + VERSION + shape + LATER + after)) for one, shape in versions(label, known)]
    return rules


#: Identifiers besides those of LICENSES and their versions, and other ways to write one (fixed values).
OTHERS = "0bsd afl-2.1 afl-3.0 apsl-2.0 blueoak-1.0.0 curl fsl-1.1 hpnd icu ijg libpng mit-0 mulanpsl-2.0 naist-2003 ntp openssl python-2.0 qpl-1.0 rpl-1.5 ruby sleepycat tcl unicode-3.0 vim x11 zlib-acknowledgement".split()
ALIASES = {
    "apache2": "apache-2.0", "apachev2": "apache-2.0", "asl": "apache", "expat": "mit", "gplv1": "gpl-1.0", "gplv2": "gpl-2.0", "gpl2": "gpl-2.0", "gplv3": "gpl-3.0", "gpl3": "gpl-3.0", "lgplv2": "lgpl-2.0", "lgplv2.1": "lgpl-2.1", "lgplv3": "lgpl-3.0",
    "lgpl3": "lgpl-3.0", "agplv3": "agpl-3.0", "agpl3": "agpl-3.0", "mplv2": "mpl-2.0", "bsd2": "bsd-2-clause", "bsd3": "bsd-3-clause", "bsd-2": "bsd-2-clause", "bsd-3": "bsd-3-clause", "boost": "bsl",
}
KNOWN = {label for label, _, _, _ in LICENSES} | {f"{label}-{v}" for label, _, known, _ in LICENSES for v in known.split()} | set(OTHERS)
#: Identifiers that are words of other languages or of daily use: labels in tags and fields alone.
PLAIN = {"artistic", "elastic", "ruby", "curl", "vim", "tcl", "php", "boost"}
#: An identifier, a version apart from it, and what joins two.
WORD_OF = re.compile(rb"[ \t]*[(\"'`\[]*[ \t]*([a-z0-9][a-z0-9.+-]*)[)\"'`\]]*")
VERSION_OF = re.compile(rb"[ \t]+(?:version[ \t]+|v\.?[ \t]*)?([0-9](?:\.[0-9]+)*)(?![0-9a-z])")
JOINT = re.compile(rb"[ \t]*[/,|&][ \t]*")
#: Where an expression begins: how certain it is, whether any known identifier counts or only those that are no
#: plain words, keyword, what stands before it.
OPENINGS = [
    (100, True, b"spdx", re.compile(rb"spdx-license-identifier:")),
    (90, True, b"licen", re.compile(rb"(?<![0-9a-z_-])licen[sc]es?[\"']?[ \t]*[:=][ \t]*(?:\{[ \t]*text[ \t]*=[ \t]*)?")),
    (86, False, b"under", re.compile(rb"(?:licen[sc]ed|released|distributed|published|available|provided|offered|covered)[ \t]+under[ \t]+(?:an?[ \t]+|the[ \t]+)?(?:terms[ \t]+of[ \t]+)?(?:the[ \t]+)?")),
    (82, False, b"licen", re.compile(rb"(?:dual|triple|multi)[ -]licen[sc]ed(?:[ \t]+under)?(?:[ \t]+(?:the|either))?")),
    (66, False, b"under", re.compile(rb"(?<![0-9a-z])under[ \t]+the[ \t]+(?=[a-z0-9.+-]+[ \t]+(?:v?[0-9.]+[ \t]+)?licen[sc]e)")),
]
#: An identifier before the word license, and two identifiers with a slash between them.
BEFORE = re.compile(rb"(?<![0-9a-z./+-])([a-z0-9][a-z0-9.+]*(?:-[a-z0-9.+]+)*?)(?:[ \t]+v?\.?([0-9](?:\.[0-9]+)?))?[ -]licen[sc]ed?(?![a-z])")
SLASH = re.compile(rb"(?<![0-9a-z./+-])([a-z0-9][a-z0-9.+-]*)/([a-z0-9][a-z0-9.+-]*)(?![0-9a-z/+-])")
DOMAIN = re.compile(rb"(?<![0-9a-z])public[ \t\n-]+domain(?![0-9a-z])")


def identified(word: str, version: str | None = None) -> str | None:
    """The label of an identifier, null where none is known; -only, -or-later and + do not make another license."""
    own = re.sub(r"(?:-only|-or-later|\+)$", "", word.rstrip("."))
    own = ALIASES.get(own, own)
    for one in ([f"{own}-{version}", f"{own}-{version}.0"] if version else []) + [own, f"{own}.0"]:
        if one in KNOWN:
            return one
    return None


def expression(low: bytes, at: int, priority: int, every: bool) -> list[Detection]:
    """The known identifiers of an expression: joined by and, or, a slash or a comma; what follows with is an
    exception. It ends with the first word that is none of these."""
    found, joined = [], True
    while m := WORD_OF.match(low, at):
        word = m[1].decode()
        if word in ("and", "or"):
            joined, at = True, m.end()
            continue
        if word == "with" and found:
            skipped = WORD_OF.match(low, m.end())
            at = skipped.end() if skipped else m.end()
            continue
        if not joined:
            break
        number = VERSION_OF.match(low, m.end())
        label = identified(word, number[1].decode() if number else None)
        if label is None or (not every and label in PLAIN):
            break
        end = m.end(1)
        if number and label.removesuffix(".0").endswith(number[1].decode().removesuffix(".0")) and label != identified(word):
            end = number.end(1)
        found.append(Detection(m.start(1), end, label, priority, False))
        at, joined = max(m.end(), end), False
        if joint := JOINT.match(low, at):
            joined, at = True, joint.end()
    return found


def notices(low: bytes) -> list[Detection]:
    """Identifiers in tags, fields and short notices."""
    found = []
    for priority, every, keyword, before in OPENINGS:
        if keyword in low:
            for m in before.finditer(low):
                found += expression(low, m.end(), priority, every)
    if b"licen" in low:
        for m in BEFORE.finditer(low):
            label = identified(m[1].decode(), m[2].decode() if m[2] else None)
            if label is not None and label not in PLAIN and label != "mit" or label == "mit" and m[2] is None:
                found.append(Detection(m.start(1), m.end(2) if m[2] else m.end(1), label, 58, False))
    if b"/" in low:
        for m in SLASH.finditer(low):
            pair = [identified(m[k].decode()) for k in (1, 2)]
            if None not in pair and not set(pair) & PLAIN:
                found += [Detection(m.start(k), m.end(k), label, 57, False) for k, label in zip((1, 2), pair, strict=True)]
    if b"domain" in low:
        found += [Detection(m.start(), m.end(), "public-domain", 55, False) for m in DOMAIN.finditer(low)]
    return found


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.by_keyword: dict[str, list[Rule]] = {}
        for r in rules:
            self.by_keyword.setdefault(r.keyword, []).append(r)
        self.keywords = ahocorasick.Automaton()
        for k in self.by_keyword:
            self.keywords.add_word(k, k)
        self.keywords.make_automaton()

    def scan(self, low: bytes) -> tuple[list[Detection], list[Detection]]:
        """(places of the base phrases, the detections left by suppression), of text with A-Z lowered."""
        found = [
            Detection(m.start(), m.end(), r.label, r.priority, r.base)
            for k in {k for _, k in self.keywords.iter(low.decode("latin-1"))}
            for r in self.by_keyword[k]
            for m in r.pattern.finditer(low)
        ]
        found += notices(low)
        return [d for d in found if d.base], suppressed(found)


def suppressed(found: list[Detection]) -> list[Detection]:
    """Those not inside one of higher priority, or of the same and longer (or first, if equal)."""
    kept: list[Detection] = []
    order = sorted(found, key=lambda d: (-d.priority, d.start, -d.end, d.label))
    for _, group in groupby(order, key=lambda d: d.priority):
        kept.sort(key=lambda d: d.start)
        starts, reach = [d.start for d in kept], list(accumulate((d.end for d in kept), max))
        own = -1
        for d in group:
            i = bisect_right(starts, d.start)
            if d.end > own and not (i and reach[i - 1] >= d.end):
                kept.append(d)
                own = d.end
    return sorted(kept, key=lambda d: d.start)


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner(rule_table())


WORD_BYTE = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("priority", T.IntegerType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("detections", T.ArrayType(SPAN)),
]


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts and places of base phrases, the labels, a score and the detections to every row.

    first_word and last_word are the least and greatest word (from 0) at which a base phrase starts,
    null without one. labels joins base_labels and those of the detections that suppression left.
    score is the highest priority among the detections as a share of 100, 0 without one. detections
    are spans of UTF-8 bytes in the text.

    Null and empty texts have no words and no labels (""); repeated rows are scanned alike; an empty
    table stays empty; columns named like an added one are replaced. Whole texts are scanned.
    """

    def build():
        scan_one = scanner().scan

        def work(texts: pa.Array) -> dict:
            raw = texts.cast(pa.binary()).to_pylist()
            cuts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))))
            inside = WORD_BYTE[np.frombuffer(b"".join(raw), np.uint8)]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            first = cuts[:-1][cuts[:-1] < len(inside)]
            begins[first] = inside[first]
            starts = np.flatnonzero(begins)
            at = np.searchsorted(starts, cuts)
            new = {f.name: [] for f in FIELDS}
            for i, data in enumerate(raw):
                base, kept = scan_one(data.lower())
                own = starts[at[i] : at[i + 1]] - cuts[i]
                places = np.searchsorted(own, [d.start for d in base]) if base else None
                new["n_words"].append(int(at[i + 1] - at[i]))
                new["n_base"].append(len(base))
                new["first_word"].append(int(places.min()) if base else None)
                new["last_word"].append(int(places.max()) if base else None)
                base_labels = {d.label for d in base}
                new["base_labels"].append(",".join(sorted(base_labels)))
                new["labels"].append(",".join(sorted(base_labels | {d.label for d in kept})))
                new["score"].append(max((d.priority for d in kept), default=0) / 100)
                new["detections"].append([{"start": d.start, "end": d.end, "label": d.label, "priority": d.priority} for d in kept])
            return new

        return work

    return with_text_columns(df, FIELDS, build, text_col)
