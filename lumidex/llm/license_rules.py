"""Hand-written license signatures.

Each line below is one rule: ``label | keyword | pattern``. Texts are matched as their lower-case
words, joined by single spaces and with a space at either end; a pattern is written over such
words and stands between word ends. A ``keyword`` is a word that every match of the rule holds:
a text without it skips the rule. Within a block, earlier rules go before later ones; the blocks
are in the order of their priority. Patterns keep to what all common regex engines read alike, and
every repetition has a bound.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Phrases whose places are reported for themselves; their labels always stay.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

IDENTIFIERS = r"""
mit | spdx | spdx license identifier mit
mit-0 | spdx | spdx license identifier mit 0
apache-2 | spdx | spdx license identifier apache 2( 0)?
apache-1 | spdx | spdx license identifier apache 1 [01]
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
0bsd | spdx | spdx license identifier 0bsd
gpl-2 | spdx | spdx license identifier gpl 2( 0)?( only| or later)?
gpl-3 | spdx | spdx license identifier gpl 3( 0)?( only| or later)?
lgpl-2.1 | spdx | spdx license identifier lgpl 2( [01])?( only| or later)?
lgpl-3 | spdx | spdx license identifier lgpl 3( 0)?( only| or later)?
agpl-3 | spdx | spdx license identifier agpl 3( 0)?( only| or later)?
mpl-1.1 | spdx | spdx license identifier mpl 1 [01]
mpl-2 | spdx | spdx license identifier mpl 2( 0)?
epl-1 | spdx | spdx license identifier epl 1( 0)?
epl-2 | spdx | spdx license identifier epl 2( 0)?
cddl-1 | spdx | spdx license identifier cddl 1 [01]
isc | spdx | spdx license identifier isc
zlib | spdx | spdx license identifier zlib
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
boost-1 | spdx | spdx license identifier bsl 1( 0)?
busl-1.1 | spdx | spdx license identifier busl 1 1
artistic-2 | spdx | spdx license identifier artistic 2( 0)?
ofl-1.1 | spdx | spdx license identifier ofl 1 [01]
psf-2 | spdx | spdx license identifier (psf|python) 2( 0)?
eupl-1.2 | spdx | spdx license identifier eupl 1 [12]
cc0-1 | spdx | spdx license identifier cc0 1( 0)?
cc-by-4 | spdx | spdx license identifier cc by 4( 0)?
cc-by-sa-4 | spdx | spdx license identifier cc by sa 4( 0)?
cc-by-nc-4 | spdx | spdx license identifier cc by nc 4( 0)?
"""

ADDRESSES = r"""
apache-2 | apache | (www )?apache org licenses license 2 0
mit | opensource | opensource org licenses? mit( license)?
bsd-2-clause | opensource | opensource org licenses? bsd 2 clause
bsd-3-clause | opensource | opensource org licenses? bsd 3 clause
apache-2 | opensource | opensource org licenses? apache 2 0
isc | opensource | opensource org licenses? isc
gpl-2 | gnu | gnu org licenses (old licenses )?gpl 2 0
gpl-3 | gnu | gnu org licenses gpl( 3 0)?
lgpl-2.1 | gnu | gnu org licenses (old licenses )?lgpl 2 [01]
lgpl-3 | gnu | gnu org licenses lgpl( 3 0)?
agpl-3 | gnu | gnu org licenses agpl( 3 0)?
fdl-1.3 | gnu | gnu org licenses fdl( 1 3)?
mpl-2 | mozilla | mozilla org (en us )?mpl 2 0
mpl-1.1 | mozilla | mozilla org (en us )?mpl mpl 1 1
epl-1 | eclipse | eclipse org legal epl v10
epl-2 | eclipse | eclipse org legal epl (v20|2 0)
unlicense | unlicense | unlicense org
wtfpl | wtfpl | wtfpl net
boost-1 | boost | boost org license 1 0
cc0-1 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | creativecommons org publicdomain mark 1 0
cc-by-4 | creativecommons | creativecommons org licenses by 4 0
cc-by-3 | creativecommons | creativecommons org licenses by 3 0
cc-by-2 | creativecommons | creativecommons org licenses by 2 [05]
cc-by-sa-4 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-nd-4 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-4 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-3 | creativecommons | creativecommons org licenses by nc 3 0
cc-by-nc-sa-4 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3 | creativecommons | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4 | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3 | creativecommons | creativecommons org licenses by nc nd 3 0
ofl-1.1 | sil | (scripts )?sil org ofl
"""

NOTICES = r"""
mit | mit | (released|licensed|distributed|available|provided|published) under (the )?(terms of )?(the )?mit license
mit | mit | (subject to|governed by|covered by) (the )?(terms of )?(the )?mit license
mit | mit | (dual )?licensed under (either )?mit (or|and) apache
mit | mit | mit licensed
apache-2 | apache | (released|licensed|distributed|available|provided|published) under (the )?(terms of )?(the )?apache license( version)? 2( 0)?
apache-2 | apache | (subject to|governed by|covered by) (the )?(terms of )?(the )?apache license( version)? 2( 0)?
apache-2 | apache | apache 2( 0)? licensed
apache-1 | apache | under (the )?(terms of )?(the )?apache( software)? license( version)? 1( [01])?
bsd-2-clause | bsd | under (the )?(terms of )?(the )?(simplified|freebsd|2 clause|two clause) bsd license
bsd-2-clause | bsd | under (the )?(terms of )?(the )?bsd (2|two) clause( license)?
bsd-3-clause | bsd | under (the )?(terms of )?(the )?(new|modified|revised|3 clause|three clause) bsd license
bsd-3-clause | bsd | under (the )?(terms of )?(the )?bsd (3|three) clause( license)?
bsd-4-clause | bsd | under (the )?(terms of )?(the )?(original|old|4 clause|four clause) bsd license
bsd | bsd | under (the )?(terms of )?(the |a )?bsd( style)? license
gpl-2 | gnu | under (the )?(terms of )?(the )?gnu general public license( as published by the free software foundation)? (version 2|v2)
gpl-3 | gnu | under (the )?(terms of )?(the )?gnu general public license( as published by the free software foundation)? (version 3|v3)
gpl-2 | foundation | as published by the free software foundation (either )?version 2 of the license
gpl-3 | foundation | as published by the free software foundation (either )?version 3 of the license
gpl | gnu | under (the )?(terms of )?(the )?gnu general public license
gpl-2 | gplv2 | under (the )?(terms of )?(the )?(gnu )?gplv2( or later)?
gpl-3 | gplv3 | under (the )?(terms of )?(the )?(gnu )?gplv3( or later)?
gpl | gpl | under (the )?(terms of )?(the )?(gnu )?gpl( license)?
lgpl-2.1 | lesser | under (the )?(terms of )?(the )?gnu lesser general public license( as published by the free software foundation)? (version 2( 1)?|v2( 1)?)
lgpl-3 | lesser | under (the )?(terms of )?(the )?gnu lesser general public license( as published by the free software foundation)? (version 3|v3)
lgpl | lesser | under (the )?(terms of )?(the )?gnu lesser general public license
lgpl-2 | library | under (the )?(terms of )?(the )?gnu library general public license
agpl-3 | affero | under (the )?(terms of )?(the )?gnu affero general public license
mpl-2 | mozilla | (subject to|under) (the )?(terms of )?(the )?mozilla public license( version|s)?( v)? 2( 0)?
mpl-1.1 | mozilla | (subject to|under) (the )?(terms of )?(the )?mozilla public license( version)? 1( [01])?
epl-1 | eclipse | under (the )?(terms of )?(the )?eclipse public license( version)?( v)? 1( 0)?
epl-2 | eclipse | under (the )?(terms of )?(the )?eclipse public license( version)?( v)? 2( 0)?
cddl-1 | cddl | under (the )?(terms of )?(the )?cddl( license)?
isc | isc | under (the )?(terms of )?(the )?isc license
zlib | zlib | under (the )?(terms of )?(the )?zlib( libpng)? license
boost-1 | boost | (distributed|licensed) under (the )?boost software license( version)?( 1( 0)?)?
wtfpl | wtfpl | under (the )?(terms of )?(the )?wtfpl
artistic-2 | artistic | under (the )?(terms of )?(the )?artistic license( version)? 2( 0)?
artistic | artistic | under (the )?(terms of )?(the )?artistic license
perl | perl | under the same terms as perl( itself)?
psf-2 | python | under (the )?(terms of )?(the )?python software foundation license
ofl-1.1 | font | under (the )?(sil )?open font license( version)?( 1 1)?
unlicense | unlicense | under (the )?(terms of )?(the )?unlicense
eupl-1.2 | european | under (the )?(terms of )?(the )?european union public licen[cs]e
ms-pl | microsoft | under (the )?(terms of )?(the )?microsoft public license
fdl-1.3 | documentation | under (the )?(terms of )?(the )?gnu free documentation license
odbl-1 | database | under (the )?(terms of )?(the )?open database license
openrail | openrail | under (the )?(terms of )?(the )?(creativeml |bigscience )?openrail( m)?( license)?
cc-by | attribution | under (a |the )?creative commons attribution( [1-4] [05])?( international| unported| generic)? license
cc-by-sa | sharealike | under (a |the )?creative commons attribution sharealike( [1-4] [05])?( international| unported)?( license)?
cc-by-sa | share | under (a |the )?creative commons attribution share alike( [1-4] [05])?( international| unported)?( license)?
cc-by-nc | noncommercial | under (a |the )?creative commons attribution noncommercial( [1-4] [05])?( international| unported)?( license)?
cc-by-nc | commercial | under (a |the )?creative commons attribution non commercial( [1-4] [05])?( international| unported)?( license)?
cc-by-nd | noderivatives | under (a |the )?creative commons attribution noderivatives( [1-4] [05])?( international| unported)?( license)?
cc-by-nd | derivatives | under (a |the )?creative commons attribution no derivatives( [1-4] [05])?( international| unported)?( license)?
cc-by-nc-sa | sharealike | under (a |the )?creative commons attribution noncommercial sharealike( [1-4] [05])?( international| unported)?( license)?
cc-by-nc-nd | noderivatives | under (a |the )?creative commons attribution noncommercial noderivatives( [1-4] [05])?( international| unported)?( license)?
cc-by | cc | (licensed|released|available|published) under (a |the )?cc by( [1-4] [05])?
cc0-1 | cc0 | (licensed|released|available|published) under (a |the )?cc0
cc | creative | under (a |the )?creative commons licen[cs]e
public-domain | domain | (released|dedicated|placed) (in|into|to) the public domain
proprietary | proprietary | under (a |the )?proprietary licen[cs]e
"""

TITLES = r"""
mit | mit | the mit license( mit)?
mit | mit | mit license
mit | expat | expat license
mit-0 | mit | mit no attribution
apache-2 | apache | apache license( version| v)? 2( 0)?
apache-2 | apache2 | apache2( 0)?( license)?
apache-1 | apache | apache( software)? license( version| v)? 1( [01])?
bsd-2-clause | bsd | bsd (2|two) clause( simplified)? license
bsd-3-clause | bsd | bsd (3|three) clause( new| revised)? license
bsd-2-clause | bsd | (2|two) clause bsd( license)?
bsd-3-clause | bsd | (3|three) clause bsd( license)?
bsd-4-clause | bsd | (4|four) clause bsd( license)?
0bsd | bsd | bsd zero clause( license)?
0bsd | 0bsd | 0bsd( license)?
bsd | bsd | bsd license
gpl-2 | gnu | gnu general public license (version 2|v2|2 0)
gpl-3 | gnu | gnu general public license (version 3|v3|3 0)
gpl-2 | gpl | gpl (version 2|v2|2( 0)?)
gpl-3 | gpl | gpl (version 3|v3|3( 0)?)
gpl-2 | gplv2 | gplv2
gpl-3 | gplv3 | gplv3
gpl | gnu | gnu general public license
gpl | gpl | gnu gpl
lgpl-2.1 | lesser | gnu lesser general public license (version 2( 1)?|v2( 1)?)
lgpl-3 | lesser | gnu lesser general public license (version 3|v3)
lgpl | lesser | gnu lesser general public license
lgpl-2.1 | lgpl | lgpl (version 2( 1)?|v2( 1)?|2( 1)?)
lgpl-3 | lgpl | lgpl (version 3|v3|3( 0)?)
lgpl-3 | lgplv3 | lgplv3
lgpl | lgpl | gnu lgpl
agpl-3 | affero | gnu affero general public license
agpl-3 | agpl | agpl( version| v)? 3( 0)?
agpl-3 | agplv3 | agplv3
mpl-2 | mozilla | mozilla public license( version| v)? 2( 0)?
mpl-1.1 | mozilla | mozilla public license( version| v)? 1( [01])?
mpl | mozilla | mozilla public license
epl-1 | eclipse | eclipse public license( version)?( v)? 1( 0)?
epl-2 | eclipse | eclipse public license( version)?( v)? 2( 0)?
epl | eclipse | eclipse public license
cddl-1 | common | common development and distribution license
cpl-1 | common | common public license( version)? 1( 0)?
cpal-1 | common | common public attribution license
isc | isc | isc license
zlib | zlib | zlib( libpng)? license
libpng | libpng | libpng license
boost-1 | boost | boost software license( version)?( 1( 0)?)?
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl( version 2)?
wtfpl | fuck | do what the fuck you want to public license
artistic-2 | artistic | artistic license( version)? 2( 0)?
artistic-1 | artistic | artistic license( version)? 1( 0)?
psf-2 | python | python software foundation license( version 2)?
php-3 | php | php license( version)? 3( 0)?
ruby | ruby | ruby license
openssl | openssl | openssl license
w3c | w3c | w3c software (notice and )?license
x11 | x11 | x11 license
ntp | ntp | ntp license
postgresql | postgresql | postgresql license
ncsa | illinois | university of illinois ncsa open source license
ecl-2 | educational | educational community license( version)? 2( 0)?
afl-3 | academic | academic free license( version| v)?( 3( 0)?)?
osl-3 | open | open software license( version| v)? 3( 0)?
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
ofl-1.1 | font | (sil )?open font license( version)?( 1 1)?
bitstream-vera | vera | bitstream vera fonts copyright
eupl-1.2 | european | european union public licen[cs]e
cecill-2 | cecill | cecill( free software)?( license)?( agreement)?
fdl-1.3 | documentation | gnu free documentation license
odbl-1 | database | open database license
odc-by-1 | data | open data commons attribution license
pddl-1 | domain | public domain dedication and license
busl-1.1 | business | business source license( 1 1)?
sspl-1 | server | server side public license
elastic-2 | elastic | elastic license( 2 0)?
commons-clause | commons | commons clause license condition
bsl-jquery | jquery | jquery license
vim | vim | vim license
json | json | json license
beerware | beerware | beerware license
beerware | beer | the beer ware license
ijg | jpeg | independent jpeg group
unicode-dfs | unicode | unicode (inc )?license agreement
openrail | openrail | (creativeml |bigscience )?openrail( m)?( license)?
llama | llama | llama [23]( [1-3])? community license
cc0-1 | cc0 | cc0( 1 0)?( universal)?
cc0-1 | zero | creative commons zero( v1 0)?( universal)?
cc-by-nc-sa | cc | cc by nc sa( [1-4] [05])?
cc-by-nc-nd | cc | cc by nc nd( [1-4] [05])?
cc-by-nc | cc | cc by nc( [1-4] [05])?
cc-by-sa | cc | cc by sa( [1-4] [05])?
cc-by-nd | cc | cc by nd( [1-4] [05])?
cc-by | cc | cc by( [1-4] [05])?
cc-by | attribution | creative commons attribution( [1-4] [05])?( international| unported| generic)?( public)? license
cc-by-sa | sharealike | creative commons attribution sharealike( [1-4] [05])?( international| unported)?( public)?( license)?
cc-by-nc | noncommercial | creative commons attribution noncommercial( [1-4] [05])?( international| unported)?( public)?( license)?
cc-by-nd | noderivatives | creative commons attribution noderivatives( [1-4] [05])?( international| unported)?( public)?( license)?
"""

CLAUSES = r"""
mit | merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | copies | the above copyright notice and this permission notice shall be included in all copies or substantial portions
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee
apache-2 | compliance | you may not use this file except in compliance with the license
apache-2 | unless | unless required by applicable law or agreed to in writing software distributed under the license
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | redistributions of source code must retain the above copyright notice
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse | may be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software
gpl | redistribute | this program is free software you can redistribute it and or modify
gpl | hope | distributed in the hope that it will be useful but without any warranty
gpl | received | you should have received a copy of the gnu general public license
lgpl | received | you should have received a copy of the gnu lesser general public license
mpl-2 | source | this source code form is subject to the terms of the mozilla public license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
zlib | misrepresented | the origin of this software must not be misrepresented
boost-1 | boost | distributed under the boost software license
cc | commons | this work is licensed under a creative commons
cc | commons | licensed under creative commons
no-license | reserved | all rights reserved
copyright | copyright | copyright( c)? (19|20)[0-9][0-9]
copyright | copyright | copyright( c)? by
proprietary | proprietary | proprietary and confidential
proprietary | confidential | confidential and proprietary
proprietary | permission | may not be (reproduced|copied|distributed|republished)( in whole or in part)? without (the )?(prior |express )?(written )?permission
proprietary | redistribute | do not redistribute
proprietary | unauthorized | unauthorized (copying|reproduction|distribution|use)
noncommercial | commercial | for non commercial use only
noncommercial | noncommercial | for noncommercial use only
noncommercial | commercial | not for commercial use
noncommercial | noncommercial | noncommercial use only
research | research | for research (purposes|use) only
evaluation | evaluation | for evaluation purposes only
personal | personal | for personal use only
royalty-free | royalty | royalty free license
"""


@dataclass(frozen=True)
class Rule:
    rule: int
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    base: bool


def rules() -> list[Rule]:
    """All rules in order, the base phrases first. A lower priority number goes before a higher one."""
    made = [Rule(i, label, phrase.split()[2 if "license" in phrase and "under" in phrase else 0], phrase, 0, 1.0, True) for i, (phrase, label) in enumerate(BASE.items())]
    blocks = ((IDENTIFIERS, 1, 1.0), (ADDRESSES, 2, 0.95), (NOTICES, 3, 0.9), (TITLES, 4, 0.7), (CLAUSES, 5, 0.5))
    for text, priority, confidence in blocks:
        for line in text.strip().splitlines():
            label, keyword, pattern = (x.strip() for x in line.split(" | "))
            made.append(Rule(len(made), label, keyword, pattern, priority, confidence, False))
    return made
