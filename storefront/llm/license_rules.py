"""Signature rules of licenses, in order: earlier sections outrank later ones.

Rules read normalised text: words in lower case, one blank between two. Each line
is ``label | expression``; a section names its rank, then the keyword (a piece of
text) without which none of its rules can match. Ranks: 0 declared identifiers, 1 grants
and license texts, 2 titles with a version and addresses, 3 titles without one, 4 mentions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

V = r"(?:v|version|ver)"
LATER = r"(?:or (?:at your option )?(?:any )?(?:later|newer|greater)|and (?:any )?later)(?: versions?)?"


@dataclass(frozen=True)
class LicenseRule:
    number: int
    rank: int
    keyword: str
    label: str
    expression: str


# Identifiers of the public license list, as written in declarations.
IDENTIFIERS = """
0bsd afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0-only agpl-1.0-or-later agpl-3.0-only agpl-3.0-or-later agpl-3.0
apache-1.0 apache-1.1 apache-2.0 apsl-1.0 apsl-2.0 artistic-1.0 artistic-1.0-perl artistic-2.0 blueoak-1.0.0 bsl-1.0 bsd-1-clause
bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsd-source-code busl-1.1
cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0
cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-3.0
cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cern-ohl-p-2.0 cern-ohl-s-2.0 cern-ohl-w-2.0
cpal-1.0 cpl-1.0 ecl-1.0 ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 etalab-2.0 eupl-1.1 eupl-1.2 fsfap
gfdl-1.1-or-later gfdl-1.2-or-later gfdl-1.3-or-later gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only
gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd imagemagick ipl-1.0 isc jpnic lgpl-2.0-only
lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng-2.0
lppl-1.3c mit mit-0 mit-modern-variant mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0
ncsa nist-pd npl-1.1 odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 ogl-uk-3.0 oldap-2.8 openssl osl-1.0 osl-2.1 osl-3.0
pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sissl sleepycat sspl-1.0 tcl unicode-dfs-2016
unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
"""

# Phrases by which licenses are granted, named and mentioned.
RULES = """
== 0 spdx license identifier
{identifiers}

== 1 permission is hereby granted
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
boost-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
ofl-1.1 | permission is hereby granted free of charge to any person obtaining a copy of the font software

== 1 permission to use
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
isc | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted

== 1 redistribution and use
bsd-4-clause | redistribution and use in source and binary forms (?:[^ ]+ ){10,90}?all advertising materials mentioning features
bsd-3-clause | redistribution and use in source and binary forms (?:[^ ]+ ){10,120}?neither the names? of
bsd-2-clause | redistribution and use in source and binary forms with or without modification are permitted

== 1 neither the name
bsd-3-clause | neither the names? of (?:[^ ]+ ){1,12}?nor the names of (?:its|the) contributors may be used to endorse

== 1 advertising materials
bsd-4-clause | all advertising materials mentioning features or use of this software must display

== 1 as published by the free software foundation
agpl-3.0-or-later | gnu affero general public license as published by the free software foundation either version 3 (?:of the license )?{LATER}
agpl-3.0 | gnu affero general public license (?:{V} 3 )?as published by the free software foundation(?: {V} 3)?
lgpl-2.1-or-later | gnu lesser general public license as published by the free software foundation either version 2 1 (?:of the license )?{LATER}
lgpl-3.0-or-later | gnu lesser general public license as published by the free software foundation either version 3 (?:of the license )?{LATER}
lgpl-2.0-or-later | gnu library general public license as published by the free software foundation either version 2 (?:of the license )?{LATER}
gpl-3.0-or-later | gnu general public license as published by the free software foundation either version 3 (?:of the license )?{LATER}
gpl-2.0-or-later | gnu general public license as published by the free software foundation either version 2 (?:of the license )?{LATER}
gpl-1.0-or-later | gnu general public license as published by the free software foundation either version 1 (?:of the license )?{LATER}
gpl-2.0 | gnu general public license {V} 2 as published by the free software foundation
gpl-3.0 | gnu general public license {V} 3 as published by the free software foundation

== 1 licensed under
apache-2.0 | licensed under the apache license {V}? ?2(?: 0)? the license you may not use this file except in compliance with the license
apache-2.0 | licensed under the apache(?: software)? license {V}? ?2(?: 0)?
mit | licensed under the (?:terms of the )?mit(?: x11)? license
gpl-3.0 | licensed under the gnu general public license(?: gpl)? {V}? ?3(?: 0)?
gpl-2.0 | licensed under the gnu general public license(?: gpl)? {V}? ?2(?: 0)?
lgpl-3.0 | licensed under the gnu lesser general public license(?: lgpl)? {V}? ?3(?: 0)?
lgpl-2.1 | licensed under the gnu lesser general public license(?: lgpl)? {V}? ?2 1
agpl-3.0 | licensed under the gnu affero general public license(?: agpl)? {V}? ?3(?: 0)?
mpl-2.0 | licensed under the mozilla public license {V}? ?2(?: 0)?
epl-2.0 | licensed under the eclipse public license {V}? ?2(?: 0)?
bsd | licensed under (?:the |a )?(?:terms of the )?bsd(?: style)? licen[cs]e
cc-by-nc-4.0 | licensed under (?:a |the )?cc by nc 4 0
cc-by-nc-nd-4.0 | licensed under (?:a |the )?cc by nc nd 4 0
cc-by-nc-sa-4.0 | licensed under (?:a |the )?cc by nc sa 4 0
cc-by-sa-4.0 | licensed under (?:a |the )?cc by sa 4 0
cc-by-nd-4.0 | licensed under (?:a |the )?cc by nd 4 0
cc-by-4.0 | licensed under (?:a |the )?cc by 4 0
cc-by-4.0 | licensed under (?:a |the )?creative commons attribution 4 0(?: international)?
cc-by-sa-4.0 | licensed under (?:a |the )?creative commons attribution share ?alike 4 0(?: international)?
proprietary | licensed under (?:a |the )?(?:commercial|proprietary) licen[cs]e

== 1 released
mit | released under the (?:terms of the )?mit licen[cs]e
bsd | released under (?:the |a )?(?:terms of the )?(?:new |simplified |modified )?bsd(?: style)? licen[cs]e
gpl | released under the (?:terms of the )?(?:gnu gpl|gpl|gnu general public licen[cs]e)
apache-2.0 | released under the apache(?: software)? licen[cs]e {V}? ?2(?: 0)?
public-domain | released (?:under|into|to) (?:the )?public domain
cc0-1.0 | released under (?:the )?(?:cc0|creative commons zero)

== 1 distributed under
mit | distributed under the (?:terms of the )?mit licen[cs]e
bsd | distributed under (?:the |a )?(?:terms of the )?bsd(?: style)? licen[cs]e
gpl | distributed under the (?:terms of the )?(?:gnu gpl|gpl|gnu general public licen[cs]e)
boost-1.0 | distributed under the boost software licen[cs]e {V}? ?1 0

== 1 subject to the
mpl-2.0 | subject to the terms of the mozilla public license {V} 2 0
mpl-1.1 | subject to the mozilla public license {V} 1 1
cddl-1.0 | subject to the terms of the common development and distribution license
upl-1.0 | subject to the terms of the universal permissive license

== 1 provided as is without any express or implied warranty
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable

== 1 unencumbered
unlicense | this is free and unencumbered software released into the public domain

== 1 public domain
public-domain | (?:placed|dedicated|put) (?:in|into|to) the public domain
public-domain | this (?:file|code|software|work|document|text) is (?:hereby )?(?:in|placed in|placed into) the public domain
cc0-1.0 | waiv(?:ed|ing) all (?:copyright and )?related (?:and|or) neighboring rights (?:[^ ]+ ){0,20}?public domain

== 1 all rights reserved
proprietary | (?:proprietary and confidential|confidential and proprietary) (?:[^ ]+ ){0,12}?all rights reserved
proprietary | all rights reserved (?:[^ ]+ ){0,12}?(?:unauthori[sz]ed (?:copying|reproduction|use|distribution)|no part of this)
copyright | (?:copyright|c) (?:c )?(?:\\d{4} )(?:[^ ]+ ){1,12}?all rights reserved

== 1 unauthori
proprietary | unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:of this (?:file|document|material|software|work) )?(?:via any medium )?is (?:strictly )?prohibited

== 1 do what the fuck
wtfpl | do what the fuck you want to public licen[cs]e

== 1 beer
beerware | the beer ?ware licen[cs]e(?: revision 42)?

== 2 gnu
agpl-3.0-or-later | gnu affero general public licen[cs]e(?: agpl)? {V}? ?3(?: 0)? {LATER}
agpl-3.0 | gnu affero general public licen[cs]e(?: agpl)? {V}? ?3(?: 0)?
gpl-3.0-or-later | gnu general public licen[cs]e(?: gpl)? {V}? ?3(?: 0)? {LATER}
gpl-3.0 | gnu general public licen[cs]e(?: gpl)? {V}? ?3(?: 0)?
gpl-2.0-or-later | gnu general public licen[cs]e(?: gpl)? {V}? ?2(?: 0)? {LATER}
gpl-2.0 | gnu general public licen[cs]e(?: gpl)? {V}? ?2(?: 0)?
gpl-1.0 | gnu general public licen[cs]e(?: gpl)? {V}? ?1(?: 0)?
lgpl-3.0-or-later | gnu lesser general public licen[cs]e(?: lgpl)? {V}? ?3(?: 0)? {LATER}
lgpl-3.0 | gnu lesser general public licen[cs]e(?: lgpl)? {V}? ?3(?: 0)?
lgpl-2.1-or-later | gnu lesser general public licen[cs]e(?: lgpl)? {V}? ?2 1 {LATER}
lgpl-2.1 | gnu lesser general public licen[cs]e(?: lgpl)? {V}? ?2 1
lgpl-2.0 | gnu library general public licen[cs]e(?: lgpl)? {V}? ?2(?: 0)?
gfdl-1.3 | gnu free documentation licen[cs]e(?: gfdl)? {V}? ?1 3
gfdl-1.2 | gnu free documentation licen[cs]e(?: gfdl)? {V}? ?1 2
gfdl-1.1 | gnu free documentation licen[cs]e(?: gfdl)? {V}? ?1 1
gpl-3.0 | www gnu org licenses gpl 3 0
gpl-2.0 | www gnu org licenses (?:old licenses )?gpl 2 0
lgpl-2.1 | www gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | www gnu org licenses lgpl 3 0
agpl-3.0 | www gnu org licenses agpl 3 0
gpl | www gnu org (?:copyleft|licenses) gpl

== 2 gpl
agpl-3.0-or-later | agpl ?v?3(?: 0)? ?(?:plus|or later)
agpl-3.0 | agpl ?{V}? ?v?3(?: 0)?
lgpl-2.1-or-later | lgpl ?v?2 1 ?(?:plus|or later)
lgpl-2.1 | lgpl ?{V}? ?v?2 1
lgpl-3.0-or-later | lgpl ?v?3(?: 0)? ?(?:plus|or later)
lgpl-3.0 | lgpl ?{V}? ?v?3(?: 0)?
lgpl-2.0 | lgpl ?{V}? ?v?2(?: 0)?
gpl-3.0-or-later | gpl ?{V}? ?v?3(?: 0)? ?(?:plus|or later|{LATER})
gpl-3.0 | gpl ?{V}? ?v?3(?: 0)?
gpl-2.0-or-later | gpl ?{V}? ?v?2(?: 0)? ?(?:plus|or later|{LATER})
gpl-2.0 | gpl ?{V}? ?v?2(?: 0)?

== 2 apache
apache-2.0 | apache(?: software)? licen[cs]e(?: asl)? {V}? ?2(?: 0)?
apache-1.1 | apache(?: software)? licen[cs]e(?: asl)? {V}? ?1 1
apache-1.0 | apache(?: software)? licen[cs]e(?: asl)? {V}? ?1 0
apache-2.0 | apache ?v?2(?: 0)? licen[cs]e
apache-2.0 | www apache org licenses license 2 0
apache-2.0 | apache 2 0

== 2 creative
cc-by-nc-nd-4.0 | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-nc-sa-4.0 | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-4.0 | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nd-4.0 | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
cc-by-sa-4.0 | creative commons attribution share ?alike 4 0(?: international)?
cc-by-4.0 | creative commons attribution 4 0(?: international)?
cc-by-nc-nd-3.0 | creative commons attribution non ?commercial no ?deriv(?:ative)?s 3 0(?: unported)?
cc-by-nc-sa-3.0 | creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
cc-by-nc-3.0 | creative commons attribution non ?commercial 3 0(?: unported)?
cc-by-sa-3.0 | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-3.0 | creative commons attribution 3 0(?: unported)?
cc-by-sa-2.5 | creative commons attribution share ?alike 2 5
cc-by-2.5 | creative commons attribution 2 5
cc0-1.0 | creative commons (?:zero|cc0)(?: {V}? ?1 0)?(?: universal)?

== 2 creativecommons
cc-by-nc-nd | creativecommons org licenses by nc nd \\d \\d
cc-by-nc-sa | creativecommons org licenses by nc sa \\d \\d
cc-by-nc | creativecommons org licenses by nc \\d \\d
cc-by-nd | creativecommons org licenses by nd \\d \\d
cc-by-sa | creativecommons org licenses by sa \\d \\d
cc-by | creativecommons org licenses by \\d \\d
cc0-1.0 | creativecommons org publicdomain zero 1 0
public-domain | creativecommons org publicdomain mark 1 0

== 2 cc
cc-by-nc-nd-4.0 | cc by nc nd 4 0
cc-by-nc-sa-4.0 | cc by nc sa 4 0
cc-by-nc-4.0 | cc by nc 4 0
cc-by-nd-4.0 | cc by nd 4 0
cc-by-sa-4.0 | cc by sa 4 0
cc-by-4.0 | cc by 4 0
cc-by-nc-nd-3.0 | cc by nc nd 3 0
cc-by-nc-sa-3.0 | cc by nc sa 3 0
cc-by-nc-3.0 | cc by nc 3 0
cc-by-nd-3.0 | cc by nd 3 0
cc-by-sa-3.0 | cc by sa 3 0
cc-by-3.0 | cc by 3 0
cc-by-2.5 | cc by 2 5
cc-by-2.0 | cc by 2 0
cc0-1.0 | cc ?0(?: 1 0)?(?: universal)?

== 2 public licen
mpl-2.0 | mozilla public licen[cs]e(?: mpl)? {V}? ?2(?: 0)?
mpl-1.1 | mozilla public licen[cs]e(?: mpl)? {V}? ?1 1
mpl-1.0 | mozilla public licen[cs]e(?: mpl)? {V}? ?1 0
epl-2.0 | eclipse public licen[cs]e(?: epl)? {V}? ?2(?: 0)?
epl-1.0 | eclipse public licen[cs]e(?: epl)? {V}? ?1(?: 0)?
eupl-1.2 | european union public licen[cs]e(?: eupl)? {V}? ?1 2
eupl-1.1 | european union public licen[cs]e(?: eupl)? {V}? ?1 1
sspl-1.0 | server side public licen[cs]e(?: sspl)?(?: {V}? ?1(?: 0)?)?
cpl-1.0 | common public licen[cs]e(?: {V}? ?1 0)?
ms-pl | microsoft public licen[cs]e(?: ms pl)?
lppl-1.3c | latex project public licen[cs]e(?: lppl)? {V}? ?1 3c?
zpl-2.1 | zope public licen[cs]e(?: zpl)?(?: {V}? ?2 1)?
qpl-1.0 | q public licen[cs]e(?: {V}? ?1 0)?
rpl-1.5 | reciprocal public licen[cs]e(?: {V}? ?1 5)?
ibm-1.0 | ibm public licen[cs]e(?: {V}? ?1 0)?

== 2 clause
bsd-2-clause | (?:bsd )?(?:2|two) clause bsd(?: licen[cs]e)?
bsd-2-clause | bsd (?:2|two) clause(?: licen[cs]e)?
bsd-3-clause | (?:3|three) clause bsd(?: licen[cs]e)?
bsd-3-clause | bsd (?:3|three) clause(?: licen[cs]e)?
bsd-4-clause | (?:4|four) clause bsd(?: licen[cs]e)?
bsd-4-clause | bsd (?:4|four) clause(?: licen[cs]e)?
0bsd | (?:0|zero) clause bsd(?: licen[cs]e)?

== 2 opensource
mit | opensource org licenses mit
isc | opensource org licenses isc
bsd-2-clause | opensource org licenses bsd 2 clause
bsd-3-clause | opensource org licenses bsd 3 clause
apache-2.0 | opensource org licenses apache 2 0
gpl-2.0 | opensource org licenses gpl 2 0
gpl-3.0 | opensource org licenses gpl 3 0
artistic-2.0 | opensource org licenses artistic (?:licen[cs]e )?2 0

== 2 licen
artistic-2.0 | artistic licen[cs]e {V}? ?2(?: 0)?
artistic-1.0 | artistic licen[cs]e {V}? ?1(?: 0)?
afl-3.0 | academic free licen[cs]e(?: afl)? {V}? ?3 0
afl-2.1 | academic free licen[cs]e(?: afl)? {V}? ?2 1
osl-3.0 | open software licen[cs]e(?: osl)? {V}? ?3 0
boost-1.0 | boost software licen[cs]e {V}? ?1 0
cddl-1.0 | common development and distribution licen[cs]e(?: cddl)? {V}? ?1 0
cddl-1.1 | common development and distribution licen[cs]e(?: cddl)? {V}? ?1 1
ofl-1.1 | (?:sil )?open font licen[cs]e(?: ofl)? {V}? ?1 1
odbl-1.0 | open (?:data commons open )?database licen[cs]e(?: odbl)?(?: {V}? ?1 0)?
odc-by-1.0 | open data commons attribution licen[cs]e(?: {V}? ?1 0)?
pddl-1.0 | public domain dedication and licen[cs]e(?: pddl)?(?: {V}? ?1 0)?
python-2.0 | python software foundation licen[cs]e(?: {V}? ?2)?
php-3.01 | php licen[cs]e {V}? ?3 01
busl-1.1 | business source licen[cs]e(?: busl?)? {V}? ?1 1
elastic-2.0 | elastic licen[cs]e {V}? ?2(?: 0)?
upl-1.0 | universal permissive licen[cs]e(?: upl)?(?: {V}? ?1 0)?
etalab-2.0 | licen[cs]e ouverte(?: etalab)?(?: {V}? ?2 0)?
ogl-uk-3.0 | open government licen[cs]e(?: {V}? ?3 0)?
openrail-m | (?:creativeml )?(?:bigscience )?open ?rail ?(?:m )?licen[cs]e

== 3 licen
mit | (?:mit|expat|mit x11|x11 mit)(?: open source| style)? licen[cs]e
isc | isc licen[cs]e
zlib | zlib(?: libpng)? licen[cs]e
x11 | x11 licen[cs]e
bsd | (?:new |simplified |modified |revised |original )?bsd(?: style)? licen[cs]e
gpl | gnu general public licen[cs]e
lgpl | gnu (?:lesser|library) general public licen[cs]e
agpl | gnu affero general public licen[cs]e
gfdl | gnu free documentation licen[cs]e
gpl | (?:gnu )?gpl licen[cs]e
apache | apache(?: software)? licen[cs]e
mpl | mozilla public licen[cs]e
epl | eclipse public licen[cs]e
artistic | (?:perl )?artistic licen[cs]e
boost-1.0 | boost software licen[cs]e
ofl-1.1 | (?:sil )?open font licen[cs]e
cc-by | creative commons attribution licen[cs]e
cc-by-sa | creative commons attribution share ?alike licen[cs]e
creative-commons | creative commons licen[cs]e
unlicense | unlicen[cs]e
vim | vim licen[cs]e
ruby | ruby licen[cs]e
php | php licen[cs]e
openssl | openssl licen[cs]e
ncsa | (?:university of illinois )?ncsa open source licen[cs]e
proprietary | (?:end user|software) licen[cs]e agreement
proprietary | (?:commercial|proprietary) licen[cs]e
cecill | (?:la )?licen[cs]e cecill
gpl | licen[cs]e publique g[ée]n[ée]rale gnu
gpl | licencia p[úu]blica general(?: de)? gnu

== 3 cc
cc-by-nc-nd | cc by nc nd
cc-by-nc-sa | cc by nc sa
cc-by-nc | cc by nc
cc-by-nd | cc by nd
cc-by-sa | cc by sa
cc-by | cc by

== 4 spdx
spdx | spdx license identifier

== 4 copyleft
copyleft | copyleft(?: licen[cs]e)?

== 4 lizenz
gpl | gnu general public lizenz
mit | mit lizenz
apache | apache lizenz
creative-commons | creative commons lizenz

== 4 copyright
copyright | copyright (?:c )?\\d{4}(?: \\d{4})?
"""


def words_of(identifier: str) -> str:
    return " ".join(re.findall(r"[0-9a-z]+", identifier))


def read_rules(source: str = RULES) -> list[LicenseRule]:
    """The rules in order; a longer identifier comes before one it begins with."""
    identifiers = "\n".join(
        f"{i} | spdx license identifier {words_of(i)}" for i in sorted(IDENTIFIERS.split(), key=lambda i: (-len(i), i))
    )
    source = source.replace("{identifiers}", identifiers).replace("{LATER}", LATER).replace("{V}", V)
    rules, rank, keyword = [], 0, ""
    for line in filter(None, map(str.strip, source.splitlines())):
        if line.startswith("=="):
            _, rank, keyword = line.split(" ", 2)
        else:
            label, expression = line.split(" | ", 1)
            rules.append(LicenseRule(len(rules), int(rank), keyword, label, expression))
    return rules


LICENSE_RULES: tuple[LicenseRule, ...] = tuple(read_rules())
