"""License signature rules.

Rules match texts in normal form: A-Z lower-cased, words (digits, a-z and non-ASCII) joined by one space. Each line of
the tables below is ``label | name patterns``; a pattern is a regular expression over whole words. From every name
come a mention, a grant ("licensed under ..."), and a tag rule; notices, titles and addresses are rules of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Priorities: a detection hides those inside it that have no higher priority.
TEXT, GRANT, TAG, ADDRESS, MENTION = 50, 40, 35, 30, 20
CONFIDENCE = {TEXT: 1.0, GRANT: 0.95, TAG: 0.9, ADDRESS: 0.8, MENTION: 0.6}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: str
    #: Literals that must all stand in the text before the pattern is tried.
    keywords: tuple[str, ...]


#: Names as they stand in running text.
NAMES = r"""
mit | mit license | mit licence | expat license | x11 license
mit-0 | mit no attribution(?: license)?
apache | apache license | apache licence | apache software license | asl 2 0
apache-1.0 | apache (?:software )?license (?:version |v)?1 0
apache-1.1 | apache (?:software )?license (?:version |v)?1 1
apache-2.0 | apache (?:software )?license (?:version |v ?)?2(?: 0)? | apache 2(?: 0)? licen[cs]e
gpl | general public licen[cs]e | gnu gpl | gplv[123]
gpl-1.0 | (?:gnu )?general public licen[cs]e (?:version |v ?)1(?: 0)?
gpl-2.0 | (?:gnu )?general public licen[cs]e (?:version |v ?)2(?: 0)? | gnu gpl ?v?2(?: 0)? | gplv2
gpl-3.0 | (?:gnu )?general public licen[cs]e (?:version |v ?)3(?: 0)? | gnu gpl ?v?3(?: 0)? | gplv3
lgpl | (?:lesser|library) general public licen[cs]e | gnu lgpl
lgpl-2.0 | (?:gnu )?library general public licen[cs]e (?:version |v ?)2(?: 0)?
lgpl-2.1 | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)2 1 | lgplv2 1
lgpl-3.0 | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)3(?: 0)? | lgplv3
agpl | affero general public licen[cs]e | gnu agpl
agpl-1.0 | affero general public licen[cs]e (?:version |v ?)1(?: 0)?
agpl-3.0 | (?:gnu )?affero general public licen[cs]e (?:version |v ?)3(?: 0)? | agplv3
gfdl | (?:gnu )?free documentation licen[cs]e
gfdl-1.1 | (?:gnu )?free documentation licen[cs]e (?:version |v ?)1 1
gfdl-1.2 | (?:gnu )?free documentation licen[cs]e (?:version |v ?)1 2
gfdl-1.3 | (?:gnu )?free documentation licen[cs]e (?:version |v ?)1 3
bsd | bsd licen[cs]e | berkeley software distribution licen[cs]e
bsd-1-clause | (?:1|one) clause bsd(?: licen[cs]e)? | bsd 1 clause
bsd-2-clause | (?:2|two) clause bsd(?: licen[cs]e)? | bsd 2 clause | simplified bsd licen[cs]e | freebsd licen[cs]e
bsd-3-clause | (?:3|three) clause bsd(?: licen[cs]e)? | bsd 3 clause | (?:new|modified|revised) bsd licen[cs]e
bsd-4-clause | (?:4|four) clause bsd(?: licen[cs]e)? | bsd 4 clause | original bsd licen[cs]e
0bsd | zero clause bsd(?: licen[cs]e)? | bsd zero clause
mpl | mozilla public licen[cs]e
mpl-1.0 | mozilla public licen[cs]e (?:version |v ?)?1 0
mpl-1.1 | mozilla public licen[cs]e (?:version |v ?)?1 1
mpl-2.0 | mozilla public licen[cs]e (?:version |v ?)?2 0
epl | eclipse public licen[cs]e
epl-1.0 | eclipse public licen[cs]e (?:version |v ?)?1 0
epl-2.0 | eclipse public licen[cs]e (?:version |v ?)?2 0
cddl | common development and distribution licen[cs]e
cddl-1.0 | common development and distribution licen[cs]e (?:version |v ?)?1 0
cpl-1.0 | common public licen[cs]e (?:version |v ?)?1 0
eupl | european union public licen[cs]e
eupl-1.1 | european union public licen[cs]e (?:version |v ?)?1 1
eupl-1.2 | european union public licen[cs]e (?:version |v ?)?1 2
isc | isc licen[cs]e | internet systems consortium licen[cs]e
zlib | zlib licen[cs]e | zlib libpng licen[cs]e
libpng | libpng licen[cs]e | png reference library licen[cs]e
boost | boost software licen[cs]e | boost licen[cs]e
bsl-1.0 | boost software licen[cs]e (?:version |v ?)?1 0
artistic | artistic licen[cs]e
artistic-1.0 | artistic licen[cs]e (?:version |v ?)?1 0
artistic-2.0 | artistic licen[cs]e (?:version |v ?)?2 0
unlicense | unlicense | the unlicense
wtfpl | wtfpl | do what the fuck you want to public licen[cs]e
cc | creative commons(?: licen[cs]e)?
cc0 | cc0 | cc zero | creative commons zero
cc-by | cc by | creative commons attribution
cc-by-2.0 | cc by 2 0 | creative commons attribution 2 0
cc-by-2.5 | cc by 2 5 | creative commons attribution 2 5
cc-by-3.0 | cc by 3 0 | creative commons attribution 3 0
cc-by-4.0 | cc by 4 0 | creative commons attribution 4 0
cc-by-sa | cc by sa | creative commons attribution share ?alike
cc-by-sa-3.0 | cc by sa 3 0 | creative commons attribution share ?alike 3 0
cc-by-sa-4.0 | cc by sa 4 0 | creative commons attribution share ?alike 4 0
cc-by-nd | cc by nd | creative commons attribution no ?deriv(?:ative)?s
cc-by-nd-4.0 | cc by nd 4 0 | creative commons attribution no ?deriv(?:ative)?s 4 0
cc-by-nc | cc by nc | creative commons attribution non ?commercial
cc-by-nc-3.0 | cc by nc 3 0 | creative commons attribution non ?commercial 3 0
cc-by-nc-4.0 | cc by nc 4 0 | creative commons attribution non ?commercial 4 0
cc-by-nc-sa | cc by nc sa | creative commons attribution non ?commercial share ?alike
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-nd | cc by nc nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0
ofl | (?:sil )?open font licen[cs]e
ofl-1.1 | (?:sil )?open font licen[cs]e (?:version |v ?)?1 1
odbl | open (?:data commons open )?database licen[cs]e
odc-by | open data commons attribution licen[cs]e
pddl | public domain dedication and licen[cs]e
psf | python software foundation licen[cs]e | psf licen[cs]e
php | php licen[cs]e
ruby | ruby licen[cs]e
perl | same terms as perl(?: itself)?
openssl | openssl licen[cs]e
ncsa | university of illinois ncsa open source licen[cs]e | ncsa open source licen[cs]e
postgresql | postgresql licen[cs]e
w3c | w3c (?:software|document)(?: notice and)? licen[cs]e
ms-pl | microsoft public licen[cs]e
ms-rl | microsoft reciprocal licen[cs]e
osl-3.0 | open software licen[cs]e(?: (?:version |v ?)?3 0)?
afl-3.0 | academic free licen[cs]e(?: (?:version |v ?)?3 0)?
qpl | q public licen[cs]e
vim | vim licen[cs]e
tcl | tcl tk licen[cs]e
curl | curl licen[cs]e
beerware | beer ?ware licen[cs]e
json | json licen[cs]e
sspl | server side public licen[cs]e
busl-1.1 | business source licen[cs]e(?: 1 1)?
elastic-2.0 | elastic licen[cs]e(?: 2 0)?
polyform | polyform (?:noncommercial|shield|small business) licen[cs]e
hippocratic | hippocratic licen[cs]e
blueoak | blue oak model licen[cs]e
upl-1.0 | universal permissive licen[cs]e
mulan | mulan permissive software licen[cs]e
cecill | cecill(?: (?:free software )?licen[cs]e)?
openrail | (?:creative ml )?open ?rail(?: m)?(?: licen[cs]e)?
"""

#: Passages of license texts and notices.
PASSAGES = r"""
mit | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions
apache-2.0 | you may not use this file except in compliance with the license
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the license
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0 | either version 2 of the license or at your option any later version
gpl-3.0 | either version 3 of the license or at your option any later version
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library)
bsd | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | all advertising materials mentioning features or use of this software must display
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-2.0 | this source code form is subject to the terms of the mozilla public license
unlicense | this is free and unencumbered software released into the public domain
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable
public-domain | (?:placed|released|dedicated) (?:in|into|to) the public domain
proprietary | all rights reserved
proprietary | proprietary and confidential
mit | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
apache-2.0 | apache license version 2 0 january 2004
apache-2.0 | licensed to the apache software foundation asf under one or more contributor license agreements
apache-1.1 | this product includes software developed by the apache software foundation
gpl-1.0 | gnu general public license version 1 february 1989
gpl-2.0 | gnu general public license version 2 june 1991
gpl-2.0 | under the terms of the gnu general public license version 2 as published by the free software foundation
gpl-3.0 | gnu general public license version 3 29 june 2007
gpl | you should have received a copy of the gnu general public license along with this program
lgpl-2.1 | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | gnu lesser general public license version 3 29 june 2007
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license along with this library
agpl-3.0 | gnu affero general public license version 3 19 november 2007
agpl | you should have received a copy of the gnu affero general public license
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
bsd | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd | this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | if a copy of the mpl was not distributed with this file you can obtain one at
epl-1.0 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution license
bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
artistic | this is free software you can redistribute it and or modify it under the same terms as (?:the )?perl
isc | the software is provided as is and the author disclaims all warranties with regard to this software
zlib | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
openssl | this product includes software developed by the openssl project for use in the openssl toolkit
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer in return
wtfpl | you just do what the fuck you want to
cc0 | to the extent possible under law (?:\S+ ){1,12}has waived all copyright and related or neighboring rights
ofl-1.1 | this font software is licensed under the sil open font license version 1 1
json | the software shall be used for good not evil
psf | psf is making python available to licensee on an as is basis
proprietary | unauthorized (?:copying|reproduction|distribution) of this (?:file|software|document) via any medium is strictly prohibited
proprietary | this (?:file|software|document) contains (?:confidential|proprietary) information
"""

#: Addresses, their marks read as spaces.
ADDRESSES = r"""
mit | opensource org licenses mit
apache | apache org licenses
apache-2.0 | apache org licenses license 2 0
gpl | gnu org licenses(?: old licenses)? gpl
gpl-2.0 | gnu org licenses(?: old licenses)? gpl 2 0
gpl-3.0 | gnu org licenses gpl 3 0
lgpl | gnu org licenses(?: old licenses)? lgpl
agpl-3.0 | gnu org licenses agpl 3 0
mpl-2.0 | mozilla org (?:en us )?mpl 2 0
epl-2.0 | eclipse org legal epl 2 0
unlicense | unlicense org
wtfpl | wtfpl net
cc | creativecommons org licenses
cc-by-4.0 | creativecommons org licenses by 4 0
cc-by-sa-4.0 | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | creativecommons org licenses by nc 4 0
cc0 | creativecommons org publicdomain zero
ofl | scripts sil org ofl
"""

_GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|offered)(?: \S+)? under (?:the )?(?:terms of (?:the )?)?"


def _lines(table: str) -> list[tuple[str, list[str]]]:
    rows = [line.split(" | ") for line in table.strip().splitlines()]
    return [(label.strip(), [p.strip() for p in patterns]) for label, *patterns in rows]


#: Patterns written by hand; every name stands for a mention and a grant, so there are more rules than that.
WRITTEN = sum(len(patterns) for table in (NAMES, PASSAGES, ADDRESSES) for _, patterns in _lines(table))


def _keywords(pattern: str) -> tuple[str, ...]:
    """Literal runs that any match holds: what stands outside groups, classes and optional characters."""
    plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", "~", pattern)
    plain = re.sub(r"\[[^\]]*\]\??|.\?", "~", plain)
    runs = {run.strip() for run in re.findall(r"[a-z0-9 ]+", plain)}
    return tuple(sorted({r for r in runs if len(r) > 2} or {max(runs, key=len, default="")} - {""}))


def build() -> list[Rule]:
    rules: list[Rule] = []

    def add(label: str, priority: int, pattern: str, keywords: tuple[str, ...]) -> None:
        rules.append(Rule(label, priority, rf"(?<!\S){pattern}(?!\S)", keywords))

    for label, names in _lines(NAMES):
        for name in names:
            words = _keywords(name)
            add(label, MENTION, name, words)
            add(label, GRANT, f"{_GRANT}(?:an? )?{name}", words)
        tag = label.replace("-", " ").replace(".", " ")
        add(label, TAG, f"spdx license identifier {tag}(?: only| or later)?", ("spdx license identifier",))
    for label, (passage,) in _lines(PASSAGES):
        add(label, TEXT, passage, _keywords(passage))
    for label, (address,) in _lines(ADDRESSES):
        add(label, ADDRESS, address, _keywords(address))
    return rules
