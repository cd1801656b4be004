"""Signature rules of license scans: what licenses are called, how they are granted, and sentences of their texts.

All patterns are written over words: lower case, one space between words, punctuation gone (``2.0`` is ``2 0``,
``gpl-3.0`` is ``gpl 3 0``). A label may take groups of its pattern (``gpl-\\1.0``). A rule is tried only in
texts that have all its keywords.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Kinds of rules in order of priority, with how sure a detection of that kind is.
KINDS = {"tag": 0.98, "grant": 0.95, "link": 0.9, "sentence": 0.85, "title": 0.8, "base": 0.6, "mention": 0.4}
#: A license's version after its name.
_V = r"(?: v| version| ver| rev)? ?"
_GRANT = r"(?:re)?(?:licen[cs]ed|released|distributed|redistributed|published|available|covered|provided|offered|governed|shared|usable|free)(?: to you)?(?: only)? (?:under|by|with|per|subject to)(?: an?| the| this)?(?: terms(?: and conditions)? of(?: the| version \d(?: \d)? of the)?)?(?: either)?(?: the)?"

#: label | keywords | names | short forms (identifiers) | link. Each makes up to four rules.
FAMILIES = r"""
mit | mit licen | mit licen[cs]e | mit | (?:opensource org licenses|mit license org|spdx org licenses) mit
mit | expat | expat licen[cs]e | expat | jclark com xml copying
mit-0 | mit no | mit no attribution(?: licen[cs]e)? | mit 0 | opensource org licenses mit 0
x11 | x11 | x11 licen[cs]e | x11 | spdx org licenses x11
isc | isc licen | isc licen[cs]e | isc | opensource org licenses isc
apache-2.0 | apache | apache (?:software )?licen[cs]e{v}2(?: 0)? | apache{v}2(?: 0)? | apache org licenses license 2 0
apache-1.1 | apache | apache (?:software )?licen[cs]e{v}1 1 | apache{v}1 1 | apache org licenses license 1 1
apache-1.0 | apache | apache (?:software )?licen[cs]e{v}1 0 | apache{v}1 0 | apache org licenses license 1 0
gpl-\1.0 | general public | (?:gnu )?general public licen[cs]e(?: gpl)?{v}([123])(?: 0)? | (?:gnu )?gpl{v}([123])(?: 0)?(?: only| or later)? | gnu org licenses (?:old licenses )?gpl ([123]) 0
gpl-\1.0 | gpl | gnu gpl{v}([123])(?: 0)? | gplv([123]) | opensource org licenses gpl ([123]) 0
lgpl-\1 | lesser general | (?:gnu )?lesser general public licen[cs]e(?: lgpl)?{v}([23](?: [01])?) | (?:gnu )?lgpl{v}([23](?: [01])?)(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl ([23] [01])
lgpl-\1 | library general | (?:gnu )?library general public licen[cs]e(?: lgpl)?{v}(2(?: 0)?) | lgplv(2(?: 0)?) | opensource org licenses lgpl (2 0)
lgpl-\1 | lgpl | gnu lgpl{v}([23](?: [01])?) | lgplv([23](?: [01])?) | opensource org licenses lgpl ([23] [01])
agpl-\1.0 | affero | (?:gnu )?affero (?:general public )?licen[cs]e(?: agpl)?{v}([13])(?: 0)? | (?:gnu )?agpl{v}([13])(?: 0)?(?: only| or later)? | gnu org licenses agpl (3) 0
agpl-\1.0 | agpl | gnu agpl{v}([13])(?: 0)? | agplv([13]) | opensource org licenses agpl (3) 0
gfdl-1.\1 | documentation license | (?:gnu )?free documentation licen[cs]e(?: gfdl)?{v}1 ([123]) | (?:gnu )?gfdl{v}1 ([123])(?: only| or later)? | gnu org licenses fdl 1 ([123])
mpl-\1 | mozilla | mozilla public licen[cs]e{v}([12] [01]) | mpl{v}([12] [01]) | mozilla org (?:en us )?mpl ([12] [01])
mpl-\1 | mpl | mpl licen[cs]e{v}([12] [01]) | mpl{v}([12] [01]) | opensource org licenses mpl ([12] [01])
epl-\1.0 | eclipse | eclipse public licen[cs]e{v}([12])(?: 0)? | epl{v}([12])(?: 0)? | eclipse org legal epl (?:v )?([12])(?:0| 0)
edl-1.0 | eclipse | eclipse distribution licen[cs]e{v}1 0 | edl{v}1 0 | eclipse org org documents edl v10
cpl-1.0 | common public | common public licen[cs]e{v}1 0 | cpl{v}1 0 | opensource org licenses cpl 1 0
cddl-1.\1 | common development | common development and distribution licen[cs]e{v}1 ([01]) | cddl{v}1 ([01]) | opensource org licenses cddl 1 ([01])
cddl-1.\1 | cddl | cddl licen[cs]e{v}1 ([01]) | cddl{v}1 ([01]) | oracle com cddl 1 ([01])
eupl-1.\1 | european union public | european union public licen[cs]e{v}1 ([012]) | eupl{v}1 ([012]) | joinup ec europa eu eupl 1 ([012])
eupl-1.\1 | eupl | eupl licen[cs]e{v}1 ([012]) | eupl{v}1 ([012]) | opensource org licenses eupl 1 ([012])
bsd-2-clause | bsd | (?:simplified|freebsd) bsd licen[cs]e|bsd 2 clause licen[cs]e|2 clause bsd licen[cs]e|two clause bsd licen[cs]e | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[cs]e|bsd 3 clause licen[cs]e|3 clause bsd licen[cs]e|three clause bsd licen[cs]e | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4-clause | bsd | (?:original|old) bsd licen[cs]e|bsd 4 clause licen[cs]e|4 clause bsd licen[cs]e|four clause bsd licen[cs]e | bsd 4 clause | spdx org licenses bsd 4 clause
0bsd | bsd | zero clause bsd(?: licen[cs]e)?|bsd zero clause licen[cs]e | 0bsd | opensource org licenses 0bsd
bsd-3-clause-clear | clear bsd | clear bsd licen[cs]e | bsd 3 clause clear | spdx org licenses bsd 3 clause clear
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?(?: licen[cs]e)? | cc0(?: 1 0)? | creativecommons org publicdomain zero 1 0
cc0-1.0 | publicdomain zero | publicdomain zero 1 0 | cc zero | creativecommons org publicdomain zero 1 0
cc-by-nc-nd-\1.0 | cc by nc nd | cc by nc nd(?: licen[cs]e)?{v}([1234])(?: 0)? | cc by nc nd ([1234]) 0 | creativecommons org licenses by nc nd ([1234]) 0
cc-by-nc-sa-\1.0 | cc by nc sa | cc by nc sa(?: licen[cs]e)?{v}([1234])(?: 0)? | cc by nc sa ([1234]) 0 | creativecommons org licenses by nc sa ([1234]) 0
cc-by-nc-\1.0 | cc by nc | cc by nc(?: licen[cs]e)?{v}([1234])(?: 0)? | cc by nc ([1234]) 0 | creativecommons org licenses by nc ([1234]) 0
cc-by-nd-\1.0 | cc by nd | cc by nd(?: licen[cs]e)?{v}([1234])(?: 0)? | cc by nd ([1234]) 0 | creativecommons org licenses by nd ([1234]) 0
cc-by-sa-\1.0 | cc by sa | cc by sa(?: licen[cs]e)?{v}([1234])(?: 0)? | cc by sa ([1234]) 0 | creativecommons org licenses by sa ([1234]) 0
cc-by-\1.0 | cc by | cc by(?: licen[cs]e)?{v}([1234])(?: 0)? | cc by ([1234]) 0 | creativecommons org licenses by ([1234]) 0
cc-by-nc-nd-\1.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?{v}([1234]) 0(?: international| unported| generic)?(?: licen[cs]e)? | - | -
cc-by-nc-sa-\1.0 | creative commons | creative commons attribution non ?commercial share ?alike{v}([1234]) 0(?: international| unported| generic)?(?: licen[cs]e)? | - | -
cc-by-nc-\1.0 | creative commons | creative commons attribution non ?commercial{v}([1234]) 0(?: international| unported| generic)?(?: licen[cs]e)? | - | -
cc-by-nd-\1.0 | creative commons | creative commons attribution no ?deriv(?:ative)?s(?: works)?{v}([1234]) 0(?: international| unported| generic)?(?: licen[cs]e)? | - | -
cc-by-sa-\1.0 | creative commons | creative commons attribution share ?alike{v}([1234]) 0(?: international| unported| generic)?(?: licen[cs]e)? | - | -
cc-by-\1.0 | creative commons | creative commons attribution{v}([1234]) 0(?: international| unported| generic)?(?: licen[cs]e)? | - | -
zlib | zlib | zlib licen[cs]e | zlib | opensource org licenses zlib
libpng | libpng | (?:zlib )?libpng licen[cs]e(?:{v}2)? | libpng(?: 2 0)? | libpng org pub png src libpng license
bsl-1.0 | boost | boost software licen[cs]e(?:{v}1 0)? | bsl 1 0 | boost org license 1 0
unlicense | unlicense | unlicen[cs]e | unlicense | unlicense org
wtfpl | wtfpl | wtfpl(?:{v}2)?(?: licen[cs]e)? | wtfpl | wtfpl net
artistic-\1.0 | artistic | artistic licen[cs]e{v}([12])(?: 0)? | artistic ([12]) 0 | opensource org licenses artistic (?:license )?([12]) 0
psf-2.0 | python | python software foundation licen[cs]e(?:{v}2)?|psf licen[cs]e(?: agreement)?(?: for python)?(?: \d)* | (?:psf|python) 2 0 | docs python org 3 license
ruby | ruby | ruby licen[cs]e | ruby | ruby lang org en about license
php-3.01 | php licen | php licen[cs]e(?:{v}3 01)? | php 3 01 | php net license 3 01
openssl | openssl | openssl licen[cs]e | openssl | openssl org source license
postgresql | postgresql | postgresql licen[cs]e | postgresql | postgresql org about licence
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[cs]e | ncsa | opensource org licenses ncsa
ms-pl | microsoft public | microsoft public licen[cs]e | ms pl | opensource org licenses ms pl
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e | ms rl | opensource org licenses ms rl
ofl-1.1 | open font | (?:sil )?open font licen[cs]e(?:{v}1 1)? | ofl 1 1 | scripts sil org ofl
odbl-1.0 | open database | (?:odc )?open database licen[cs]e(?: odbl)?(?:{v}1 0)? | odbl(?: 1 0)? | opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0 | open data commons | open data commons attribution licen[cs]e(?:{v}1 0)? | odc by 1 0 | opendatacommons org licenses by(?: 1 0)?
pddl-1.0 | public domain dedication | (?:open data commons )?public domain dedication and licen[cs]e(?:{v}1 0)? | pddl 1 0 | opendatacommons org licenses pddl(?: 1 0)?
apsl-2.0 | apple public | apple public source licen[cs]e{v}2 0 | apsl 2 0 | opensource apple com apsl
afl-3.0 | academic free | academic free licen[cs]e{v}3 0 | afl 3 0 | opensource org licenses afl 3 0
osl-3.0 | open software license | open software licen[cs]e{v}3 0 | osl 3 0 | opensource org licenses osl 3 0
ecl-2.0 | educational community | educational community licen[cs]e{v}2 0 | ecl 2 0 | opensource org licenses ecl 2 0
qpl-1.0 | q public | q public licen[cs]e(?:{v}1 0)? | qpl 1 0 | opensource org licenses qpl 1 0
sleepycat | sleepycat | sleepycat licen[cs]e | sleepycat | opensource org licenses sleepycat
w3c | w3c | w3c (?:r )?software (?:notice and|and document(?: notice and)?) licen[cs]e | w3c | w3 org consortium legal 2015 copyright software and document
vim | vim licen | vim licen[cs]e | vim | vimhelp org uganda txt
unicode-dfs-2016 | unicode | unicode (?:inc )?licen[cs]e agreement(?: data files and software)? | unicode dfs 2016 | unicode org copyright
json | json licen | json licen[cs]e | json | json org license
beerware | beer | beer ?ware licen[cs]e(?: revision 42)? | beerware | people freebsd org phk
cecill-\1 | cecill | cecill(?: free software)? licen[cs]e(?: agreement)?{v}([12] [01]) | cecill ([12] [01]) | cecill info licences licence cecill v([12] [01])
cecill-b | cecill | cecill b(?: free software)? licen[cs]e(?: agreement)? | cecill b | cecill info licences licence cecill b
cecill-c | cecill | cecill c(?: free software)? licen[cs]e(?: agreement)? | cecill c | cecill info licences licence cecill c
busl-1.1 | business source | business source licen[cs]e(?:{v}1 1)? | busl 1 1 | mariadb com bsl11
sspl-1.0 | server side public | server side public licen[cs]e(?: sspl)?(?:{v}1)? | sspl 1 0 | mongodb com licensing server side public license
elastic-2.0 | elastic | elastic licen[cs]e(?:{v}2(?: 0)?)? | elastic 2 0 | elastic co licensing elastic license
openrail | openrail | (?:creativeml |bigscience )?(?:bloom |big ?code )?open ?rail(?: m| s)?(?: licen[cs]e)? | openrail(?: m)? | bigscience huggingface co blog the bigscience rail license
hpnd | historical permission | historical permission notice and disclaimer | hpnd | opensource org licenses hpnd
curl | curl | curl licen[cs]e | curl | curl se docs copyright
ftl | freetype | freetype (?:project )?licen[cs]e | ftl | freetype org license
ijg | jpeg group | independent jpeg group(?: s)? licen[cs]e | ijg | spdx org licenses ijg
icu | icu licen | icu licen[cs]e | icu | source icu project org repos icu
tcl | tcl tk | tcl tk licen[cs]e | tcl | tcl tk software tcltk license terms
lppl-1.3c | latex | latex project public licen[cs]e(?:{v}1 3c?)? | lppl 1 3c | latex project org lppl
mulanpsl-2.0 | mulan | mulan permissive software licen[cs]e(?:{v}2)?|mulan psl(?: v2)? | mulanpsl 2 0 | license coscl org cn mulanpsl2
blueoak-1.0.0 | blue oak | blue oak model licen[cs]e(?:{v}1 0 0)? | blueoak 1 0 0 | blueoakcouncil org license 1 0 0
upl-1.0 | universal permissive | universal permissive licen[cs]e(?:{v}1 0)? | upl 1 0 | oss oracle com licenses upl
nasa-1.3 | nasa | nasa open source agreement(?:{v}1 3)? | nasa 1 3 | opensource org licenses nasa 1 3
cern-ohl-\1-2.0 | cern | cern open hardware licen[cs]e{v}2 (?:permissive|weakly reciprocal|strongly reciprocal|([pws])) | cern ohl ([pws]) 2 0 | ohwr org cern ohl ([pws])
watcom-1.0 | watcom | sybase open watcom public licen[cs]e(?:{v}1 0)? | watcom 1 0 | opensource org licenses watcom 1 0
rpl-1.5 | reciprocal public | reciprocal public licen[cs]e(?:{v}1 5)? | rpl 1 5 | opensource org licenses rpl 1 5
eudatagrid | datagrid | eu datagrid software licen[cs]e | eudatagrid | opensource org licenses eudatagrid
spl-1.0 | sun public | sun public licen[cs]e(?:{v}1 0)? | spl 1 0 | opensource org licenses spl 1 0
ipl-1.0 | ibm public | ibm public licen[cs]e(?:{v}1 0)? | ipl 1 0 | opensource org licenses ipl 1 0
ogl-uk-3.0 | open government | open government licen[cs]e{v}3 0 | ogl uk 3 0 | nationalarchives gov uk doc open government licence version 3
etalab-2.0 | etalab | (?:licence ouverte )?etalab(?: open licen[cs]e)?{v}2 0 | etalab 2 0 | etalab gouv fr licence ouverte
dl-de-by-2.0 | datenlizenz | datenlizenz deutschland namensnennung(?:{v}2 0)? | dl de by 2 0 | govdata de dl de by 2 0
"""

#: label | keywords | pattern: sentences by which a license's own text is known.
SENTENCES = r"""
mit | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | the above copyright notice | the above copyright notice and this permission notice shall be included in all copies
mit | noninfringement | warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors
isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | without fee | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
bsd | source and binary | redistribution and use in source and binary forms with or without modification are permitted provided that
bsd-3-clause | endorse or promote | neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
bsd | reproduce the above | redistributions in binary form must reproduce the above copyright notice
bsd | retain the above | redistributions of source code must retain the above copyright notice
apache-2.0 | apache license | you may not use this file except in compliance with the license
apache-2.0 | apache | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
apache-1.1 | apache | this product includes software developed by the apache software foundation
gpl | free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | general public license | you should have received a copy of the gnu general public license along with this program
gpl | absolutely no warranty | (?:this program|[^ ]+) comes with absolutely no warranty
gpl-2.0-or-later | version 2 | either version 2 (?:of the license )?or at your option any later version
gpl-3.0-or-later | version 3 | either version 3 (?:of the license )?or at your option any later version
lgpl | free software | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | lesser general | you should have received a copy of the gnu lesser general public license along with
agpl | affero | you should have received a copy of the gnu affero general public license along with
agpl | network | modified version must prominently offer all users interacting with it remotely through a computer network
gfdl | invariant sections | with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | eclipse public | this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0
epl-2.0 | eclipse public | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
cddl-1.0 | cddl | the contents of this file are subject to the terms of the common development and distribution license
zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | origin of this software | the origin of this software must not be misrepresented
bsl-1.0 | boost | distributed under the boost software license version 1 0
unlicense | public domain | this is free and unencumbered software released into the public domain
unlicense | unlicense | for more information please refer to (?:http|https) unlicense org
wtfpl | do what the | do what the f[^ ]+ you want to public license
cc0-1.0 | waive | to the extent possible under law (?:[^ ]+ ){1,12}(?:has|have) waived all copyright and related or neighboring rights
cc | creative commons | this work is licensed under a creative commons(?: attribution)?(?: [^ ]+){0,6} license
cc | creative commons | to view a copy of this license visit (?:http|https) creativecommons org
odbl-1.0 | open database | this (?:[^ ]+ ){1,6}is made available under the open database license
ofl-1.1 | font software | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | reserved font name | no modified version of the font software may use the reserved font name
artistic | standard version | you may distribute verbatim copies of the source form of the standard version
psf-2.0 | python | psf is making python available to licensee on an as is basis
openssl | openssl | this product includes software developed by the openssl project
postgresql | postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
ncsa | deal with the software | to deal with the software without restriction including without limitation the rights to use copy modify merge publish
ms-pl | reciprocal grant | each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution
json | good not evil | the software shall be used for good not evil
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
busl-1.1 | change date | (?:on|effective on) the change date or the fourth anniversary of the first publicly available distribution
sspl-1.0 | service source code | make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | hosted or managed | you may not provide the software to third parties as a hosted or managed service
openrail | use based restrictions | use based restrictions (?:as )?(?:referenced|set forth) in (?:paragraph|attachment)
ijg | jpeg | this software is based in part on the work of the independent jpeg group
ftl | freetype | portions of this software are copyright (?:[^ ]+ ){1,8}the freetype project
lppl-1.3c | latex project | this work may be distributed and or modified under the conditions of the latex project public license
cecill | cecill | this software is governed by the cecill (?:[abc] )?license under french law
eupl | eupl | licensed under the eupl(?: version)? 1 [012]
ogl-uk-3.0 | public sector | contains public sector information licensed under the open government licence v ?3 0
public-domain | public domain | (?:this (?:[^ ]+ ){1,4})?(?:is|are|has been|have been|was) (?:released |placed |dedicated |put )?(?:in|into|to) the public domain
proprietary | proprietary | (?:this (?:[^ ]+ ){1,4})?(?:is|contains) (?:the )?(?:confidential and )?proprietary (?:and confidential )?(?:information|property|software|material)
proprietary | without the prior | may not be (?:copied|reproduced|redistributed|distributed) (?:[^ ]+ ){0,12}without the prior written (?:permission|consent)
proprietary | trade secret | (?:contains|constitutes) (?:valuable )?trade secrets? of
non-commercial | non commercial | (?:for )?non commercial (?:use|purposes|research purposes) only
research-only | research | for research (?:use|purposes) only
all-rights-reserved | all rights reserved | (?:copyright (?:c )?(?:[^ ]+ ){0,8})?all rights reserved
"""

#: label | keywords | pattern: what says little more than that a license is spoken of.
MENTIONS = r"""
gpl | gpl | gnu gpl|under the gpl|gpl licen[cs]e
lgpl | lgpl | gnu lgpl|under the lgpl|lgpl licen[cs]e
agpl | agpl | gnu agpl|under the agpl|agpl licen[cs]e
gfdl | gfdl | gnu gfdl|under the gfdl
bsd | bsd | bsd(?: style| like)? licen[cs]e
apache | apache | apache style licen[cs]e|under the apache licen[cs]e
mpl | mpl | under the mpl|mpl licen[cs]e
cc | creative commons | creative commons(?: public)? licen[cs]e
cc-by-sa | cc by sa | cc by sa
cc-by-nc | cc by nc | cc by nc
cc-by-nd | cc by nd | cc by nd
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc-nd | cc by nc nd | cc by nc nd
public-domain | public domain | (?:in|into) the public domain
copyleft | copyleft | copyleft(?: licen[cs]e)?
open-source | open source license | (?:an|any|osi approved) open source licen[cs]e
"""

#: Phrases and labels of the contract.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]


@dataclass(frozen=True)
class Rule:
    """label: what a detection says; groups of the pattern fill it in. Rules of a lower number of priority
    suppress what they contain of later ones, and of equal priority the earlier rule wins."""

    label: str
    kind: str
    keywords: tuple[str, ...]
    pattern: str

    @property
    def priority(self) -> int:
        return list(KINDS).index(self.kind)

    def compiled(self) -> re.Pattern[str]:
        """The pattern at word boundaries. Base phrases are found at every place, also where they overlap."""
        if self.kind == "base":
            return re.compile(f"(?<![^ ])(?={self.pattern}(?![^ ]))")
        return re.compile(f"(?<![^ ])(?:{self.pattern})(?![^ ])")


def _fields(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in table.strip().splitlines()]


def _keywords(text: str) -> tuple[str, ...]:
    return tuple(k.strip() for k in text.split(" + "))


def _opening(pattern: str) -> str:
    """The letters that every match of a pattern has after what may be left out at its beginning."""
    must = re.sub(r"^(?:\(\?:[^()]*\)\?)+", "", pattern)
    found = re.match(r"[a-z0-9 ]*", must)[0]
    return (found[:-1] if must[len(found) :][:1] in ("?", "*") else found).strip()


def rules(base: list[tuple[str, str]] = BASE) -> list[Rule]:
    """All rules in order: tags, grants, links, sentences, titles, base phrases (as the caller gives them), mentions."""
    families = [(label, _keywords(keys), *[p.replace("{v}", _V) for p in parts]) for label, keys, *parts in _fields(FAMILIES)]
    out: list[Rule] = []
    for label, keys, names, short, link in families:
        if short != "-":
            out.append(Rule(label, "tag", ("spdx",), f"spdx license identifier (?:{short})"))
            if "0" in short:
                out.append(Rule(label, "tag", ("license", _opening(short) or keys[0]), f"licen[cs]e(?: expression| file| id| name| type)?(?: is)? (?:{short})"))
            out.append(Rule(label, "grant", ("under", _opening(short) or keys[0]), f"{_GRANT} (?:{short})"))
        out.append(Rule(label, "grant", keys, f"{_GRANT} (?:{names})"))
        if link != "-":
            out.append(Rule(label, "link", (_opening(link) or keys[0],), link))
        out.append(Rule(label, "title", keys, names))
    out += [Rule(label, "sentence", _keywords(keys), p) for label, keys, p in _fields(SENTENCES)]
    out += [Rule(label, "base", (phrase,), re.escape(phrase).replace(r"\ ", " ")) for phrase, label in base]
    out += [Rule(label, "mention", _keywords(keys), p) for label, keys, p in _fields(MENTIONS)]
    return sorted(dict.fromkeys(out), key=lambda r: r.priority)
