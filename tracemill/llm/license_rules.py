r"""The signature rules of license scans, written by hand: label, priority, gate words, pattern.

A pattern is a regular expression over lower-cased words that one space parts; a space in it is the border of two
words, and it begins and ends at a word's border. Gate words: one of them stands in every match. Priority 4 is an
identifier or a license with its version, 3 a license's name or the wording that only it has, 2 a family or a way of
licensing, 1 a bare notice. The order of the rules decides among equals. No pattern is unbounded in words, and none
needs look-around, so any regular-expression engine gives the same leftmost matches.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    gates: tuple[str, ...]
    pattern: str


#: Phrases whose places are always reported, with their labels (fixed values).
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

_TEXT = r"""
# identifiers in source files
spdx-apache-2.0 | 4 | spdx | spdx licen[sc]e identifier apache 2 0
spdx-mit | 4 | spdx | spdx licen[sc]e identifier mit( 0)?
spdx-gpl-2.0 | 4 | spdx | spdx licen[sc]e identifier gpl 2 0( only| or later)?
spdx-gpl-3.0 | 4 | spdx | spdx licen[sc]e identifier gpl 3 0( only| or later)?
spdx-lgpl | 4 | spdx | spdx licen[sc]e identifier lgpl [23] [01]( only| or later)?
spdx-agpl | 4 | spdx | spdx licen[sc]e identifier agpl [13] 0( only| or later)?
spdx-bsd | 4 | spdx | spdx licen[sc]e identifier bsd [0-4] clause( [a-z]+){0,3}
spdx-mpl | 4 | spdx | spdx licen[sc]e identifier mpl [12] [01]
spdx-epl | 4 | spdx | spdx licen[sc]e identifier epl [12] 0
spdx-cc | 4 | spdx | spdx licen[sc]e identifier cc (by|zero|0)( [a-z0-9]+){0,4}
spdx-isc | 4 | spdx | spdx licen[sc]e identifier isc
spdx-unlicense | 4 | spdx | spdx licen[sc]e identifier unlicense
spdx-zlib | 4 | spdx | spdx licen[sc]e identifier zlib
spdx-bsl | 4 | spdx | spdx licen[sc]e identifier bsl 1 0
spdx-artistic | 4 | spdx | spdx licen[sc]e identifier artistic [12] 0
spdx-other | 2 | spdx | spdx licen[sc]e identifier [^ ]+
spdx-copyright | 2 | spdx | spdx filecopyrighttext( [^ ]+){1,3}
spdx-package | 2 | spdx | spdx (packagename|packageid|documentnamespace|version)
# apache
apache-2.0 | 4 | apache | apache licen[sc]e( version)? (2|2 0|v2|v2 0)
apache-2.0 | 4 | apache | apache (software )?(licen[sc]e )?(v|version )2( 0)?
apache-2.0 | 4 | apache | www apache org licenses license 2 0( txt| html)?
apache-2.0 | 4 | asl20,asl2 | (asl20|asl2)( 0)?
apache-1.1 | 4 | apache | apache (software )?licen[sc]e( version)? (1 1|v1 1)
apache-1.0 | 4 | apache | apache (software )?licen[sc]e( version)? (1 0|v1 0)
apache-2.0 | 3 | compliance | you may not use this file except in compliance with the licen[sc]e
apache-2.0 | 3 | distributed | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e
apache | 3 | apache | (the )?apache software foundation licen[sc]e
apache | 3 | apache | licen[sc]ed to the apache software foundation
apache | 2 | apache | apache (software )?licen[sc]ed?
apache | 2 | apache | apache style licen[sc]e
# mit and its kin
mit | 3 | mit | (the )?mit licen[sc]e( mit)?
mit | 3 | mit | licen[sc]ed under( the)? mit
mit | 3 | mit | released under( the)? mit
mit | 3 | mit | opensource org licen[sc]es mit( license)?( php| html)?
mit | 3 | expat | expat( mit)? licen[sc]e
mit | 3 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 3 | merge | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 3 | substantial | shall be included in all copies or substantial portions of the software
mit-0 | 4 | mit | mit (0|no attribution)( licen[sc]e)?
x11 | 3 | x11 | x11 licen[sc]e
x11 | 3 | consortium | except as contained in this notice the name of the x consortium
mit | 2 | mit | mit style licen[sc]e
mit | 2 | mit | dual( licen[sc]ed)?( under)? mit
# bsd
bsd-2-clause | 4 | bsd | (simplified|freebsd|2 clause|two clause) bsd licen[sc]e
bsd-2-clause | 4 | bsd | bsd 2 clause( simplified)?( licen[sc]e)?
bsd-3-clause | 4 | bsd | (new|revised|modified|3 clause|three clause) bsd licen[sc]e
bsd-3-clause | 4 | bsd | bsd 3 clause( new| revised)?( licen[sc]e)?
bsd-4-clause | 4 | bsd | (original|old|4 clause|four clause) bsd licen[sc]e
bsd-4-clause | 4 | bsd | bsd 4 clause( original| old)?( licen[sc]e)?
bsd-1-clause | 4 | bsd | bsd 1 clause( licen[sc]e)?
0bsd | 4 | 0bsd | 0bsd( licen[sc]e)?
0bsd | 4 | bsd | (zero clause|0 clause) bsd( licen[sc]e)?
bsd-3-clause | 3 | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 3 | neither | neither the name of( [^ ]+){1,8} nor the names of its contributors
bsd-4-clause | 3 | advertising | all advertising materials mentioning features or use of this software must display
bsd | 3 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 3 | redistributions | redistributions of source code must retain the above copyright notice
bsd | 3 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd | 2 | bsd | (the )?bsd licen[sc]e
bsd | 2 | bsd | bsd style licen[sc]e
bsd | 2 | bsd | bsd licen[sc]ed
# gpl
gpl-3.0 | 4 | gnu | gnu general public licen[sc]e( gpl)?( as published by the free software foundation)?( either)? (version |v)3( 0)?
gpl-2.0 | 4 | gnu | gnu general public licen[sc]e( gpl)?( as published by the free software foundation)?( either)? (version |v)2( 0)?
gpl-1.0 | 4 | gnu | gnu general public licen[sc]e( gpl)?( as published by the free software foundation)?( either)? (version |v)1( 0)?
gpl-3.0 | 4 | general | general public licen[sc]e (version |v)3( 0)?
gpl-2.0 | 4 | general | general public licen[sc]e (version |v)2( 0)?
gpl-3.0 | 4 | gpl,gplv3,gpl3 | (gplv3|gpl3|gpl (v3|3|3 0|version 3))( or later| only)?
gpl-2.0 | 4 | gpl,gplv2,gpl2 | (gplv2|gpl2|gpl (v2|2|2 0|version 2))( or later| only)?
gpl | 3 | gnu | (the )?gnu general public licen[sc]e
gpl | 3 | gnu | gnu gpl
gpl | 3 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl | 3 | received | you should have received a copy of the gnu general public licen[sc]e
gpl | 2 | gpl | (the )?gpl licen[sc]ed?
gpl | 2 | gpl | under( the)?( terms of the)? gpl
gpl-classpath | 4 | classpath | (gpl|license) (2 0 )?with classpath exception
gpl-classpath | 3 | classpath | classpath exception
gpl-linking | 3 | linking | gpl linking exception
gpl-font | 3 | font | gpl font exception
gcc-exception | 4 | gcc | gcc runtime library exception( 3 1| version 3 1)?
autoconf-exception | 3 | autoconf | autoconf configure script exception
bison-exception | 3 | bison | bison( parser)? exception
or-later | 2 | later | (version )?[0-9]( [0-9])? (of the licen[sc]e )?or at your option any later version
or-later | 2 | later | any later version( published by the free software foundation)?
# lgpl and agpl
lgpl-3.0 | 4 | gnu | gnu lesser general public licen[sc]e( lgpl)?( as published by the free software foundation)?( either)? (version |v)3( 0)?
lgpl-2.1 | 4 | gnu | gnu (lesser|library) general public licen[sc]e( lgpl)?( as published by the free software foundation)?( either)? (version |v)2 1
lgpl-2.0 | 4 | gnu | gnu library general public licen[sc]e( lgpl)?( as published by the free software foundation)?( either)? (version |v)2( 0)?
lgpl-3.0 | 4 | lgpl,lgplv3,lgpl3 | (lgplv3|lgpl3|lgpl (v3|3|3 0|version 3))( or later| only)?
lgpl-2.1 | 4 | lgpl,lgplv2 | (lgplv2 1|lgpl (v2 1|2 1|version 2 1))( or later| only)?
lgpl | 3 | lesser | (gnu )?lesser general public licen[sc]e
lgpl | 3 | library | (gnu )?library general public licen[sc]e
lgpl | 2 | lgpl | (the |gnu )?lgpl( licen[sc]ed?)?
agpl-3.0 | 4 | affero | (gnu )?affero general public licen[sc]e( agpl)?( as published by the free software foundation)?( either)? (version |v)3( 0)?
agpl-1.0 | 4 | affero | affero general public licen[sc]e (version |v)1( 0)?
agpl-3.0 | 4 | agpl,agplv3,agpl3 | (agplv3|agpl3|agpl (v3|3|3 0|version 3))( or later| only)?
agpl | 3 | affero | (gnu )?affero general public licen[sc]e
agpl | 2 | agpl | (the |gnu )?agpl( licen[sc]ed?)?
gfdl-1.3 | 4 | gnu | gnu free documentation licen[sc]e( gfdl)? (version |v)1 3
gfdl-1.2 | 4 | gnu | gnu free documentation licen[sc]e( gfdl)? (version |v)1 2
gfdl-1.1 | 4 | gnu | gnu free documentation licen[sc]e( gfdl)? (version |v)1 1
gfdl | 3 | documentation | (gnu )?free documentation licen[sc]e
gfdl | 2 | gfdl | (the |gnu )?gfdl
gfdl-invariant | 2 | invariant | with( no| the)? invariant sections( no front cover texts)?
# creative commons, short names and full ones
cc-by-4.0 | 4 | cc | cc by (v)?4( 0)?
cc-by-3.0 | 4 | cc | cc by (v)?3( 0)?
cc-by-2.5 | 4 | cc | cc by 2 5
cc-by-2.0 | 4 | cc | cc by 2 0
cc-by-sa-4.0 | 4 | cc | cc by sa (v)?4( 0)?
cc-by-sa-3.0 | 4 | cc | cc by sa (v)?3( 0)?
cc-by-sa-2.5 | 4 | cc | cc by sa 2 5
cc-by-sa-2.0 | 4 | cc | cc by sa 2 0
cc-by-nc-4.0 | 4 | cc | cc by nc (v)?4( 0)?
cc-by-nc-3.0 | 4 | cc | cc by nc (v)?3( 0)?
cc-by-nc-2.0 | 4 | cc | cc by nc 2 [05]
cc-by-nd-4.0 | 4 | cc | cc by nd (v)?4( 0)?
cc-by-nd-3.0 | 4 | cc | cc by nd (v)?3( 0)?
cc-by-nc-sa-4.0 | 4 | cc | cc by nc sa (v)?4( 0)?
cc-by-nc-sa-3.0 | 4 | cc | cc by nc sa (v)?3( 0)?
cc-by-nc-nd-4.0 | 4 | cc | cc by nc nd (v)?4( 0)?
cc-by-nc-nd-3.0 | 4 | cc | cc by nc nd (v)?3( 0)?
cc-by-sa | 3 | cc | cc by sa
cc-by-nc | 3 | cc | cc by nc
cc-by-nd | 3 | cc | cc by nd
cc-by-nc-sa | 3 | cc | cc by nc sa
cc-by-nc-nd | 3 | cc | cc by nc nd
cc0-1.0 | 4 | cc0 | cc0 (v)?1( 0)?( universal)?
cc0-1.0 | 4 | cc | cc 0 1 0( universal)?
cc0 | 3 | cc0 | cc0( public domain dedication)?
cc0 | 3 | zero | creative commons zero( v?1 0)?( universal)?
cc-by-4.0 | 4 | creativecommons | creativecommons org licenses by 4 0( deed [a-z]+| legalcode)?
cc-by-3.0 | 4 | creativecommons | creativecommons org licenses by 3 0( deed [a-z]+| legalcode)?
cc-by-sa-4.0 | 4 | creativecommons | creativecommons org licenses by sa 4 0( deed [a-z]+| legalcode)?
cc-by-sa-3.0 | 4 | creativecommons | creativecommons org licenses by sa 3 0( deed [a-z]+| legalcode)?
cc-by-nc-4.0 | 4 | creativecommons | creativecommons org licenses by nc 4 0( deed [a-z]+| legalcode)?
cc-by-nd-4.0 | 4 | creativecommons | creativecommons org licenses by nd 4 0( deed [a-z]+| legalcode)?
cc-by-nc-sa-4.0 | 4 | creativecommons | creativecommons org licenses by nc sa 4 0( deed [a-z]+| legalcode)?
cc-by-nc-nd-4.0 | 4 | creativecommons | creativecommons org licenses by nc nd 4 0( deed [a-z]+| legalcode)?
cc0-1.0 | 4 | creativecommons | creativecommons org publicdomain zero 1 0
cc-pdm | 4 | creativecommons | creativecommons org publicdomain mark 1 0
creative-commons | 2 | creativecommons | creativecommons org
cc-by-4.0 | 4 | commons | creative commons attribution 4 0( international)?( public)?( licen[sc]e)?
cc-by-3.0 | 4 | commons | creative commons attribution 3 0( unported| [a-z]+)?( licen[sc]e)?
cc-by-sa-4.0 | 4 | commons | creative commons attribution share ?alike 4 0( international)?( licen[sc]e)?
cc-by-sa-3.0 | 4 | commons | creative commons attribution share ?alike 3 0( unported)?( licen[sc]e)?
cc-by-nc-4.0 | 4 | commons | creative commons attribution non ?commercial 4 0( international)?( licen[sc]e)?
cc-by-nd-4.0 | 4 | commons | creative commons attribution no ?deriv(ative)?s 4 0( international)?( licen[sc]e)?
cc-by-nc-sa-4.0 | 4 | commons | creative commons attribution non ?commercial share ?alike 4 0( international)?( licen[sc]e)?
cc-by-nc-nd-4.0 | 4 | commons | creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)?( licen[sc]e)?
cc-by-sa | 3 | commons | creative commons attribution share ?alike( licen[sc]e)?
cc-by-nc | 3 | commons | creative commons attribution non ?commercial( licen[sc]e)?
cc-by-nd | 3 | commons | creative commons attribution no ?deriv(ative)?s( licen[sc]e)?
cc-by-nc-sa | 3 | commons | creative commons attribution non ?commercial share ?alike( licen[sc]e)?
cc-by-nc-nd | 3 | commons | creative commons attribution non ?commercial no ?deriv(ative)?s( licen[sc]e)?
cc-by | 3 | commons | creative commons attribution( licen[sc]e)?
creative-commons | 2 | commons | (a )?creative commons licen[sc]e
creative-commons | 1 | commons | creative commons
cc-pdm | 3 | domain | public domain mark( 1 0)?
# other open licenses
mpl-2.0 | 4 | mozilla | mozilla public licen[sc]e( mpl)?( version)? (v ?)?2( 0)?
mpl-1.1 | 4 | mozilla | mozilla public licen[sc]e( mpl)?( version)? (v ?)?1 1
mpl-1.0 | 4 | mozilla | mozilla public licen[sc]e( mpl)?( version)? (v ?)?1 0
mpl-2.0 | 4 | mpl | mpl (v2|2|v2 0|2 0)
mpl-1.1 | 4 | mpl | mpl (v1 1|1 1)
mpl | 3 | mozilla | mozilla public licen[sc]e
mpl | 3 | mozilla | mozilla org mpl
epl-2.0 | 4 | eclipse | eclipse public licen[sc]e( epl)?( version)? (v ?)?2( 0)?
epl-1.0 | 4 | eclipse | eclipse public licen[sc]e( epl)?( version)? (v ?)?1( 0)?
epl | 3 | eclipse | eclipse public licen[sc]e
epl | 3 | eclipse | eclipse org legal epl( v?[12] ?0)?
edl-1.0 | 4 | eclipse | eclipse distribution licen[sc]e( version)? (v ?)?1 0
cddl-1.1 | 4 | cddl | cddl( version)? (v)?1 1
cddl-1.0 | 4 | cddl | cddl( version)? (v)?1 0
cddl | 3 | distribution | common development and distribution licen[sc]e( cddl)?
cpl-1.0 | 4 | common | common public licen[sc]e( version)? (v ?)?1 0
cpl | 3 | common | common public licen[sc]e
cpal-1.0 | 3 | common | common public attribution licen[sc]e( version)?( 1 0)?
artistic-2.0 | 4 | artistic | artistic licen[sc]e( version)? (v ?)?2( 0)?
artistic-1.0 | 4 | artistic | artistic licen[sc]e( version)? (v ?)?1( 0)?
artistic | 3 | artistic | (the )?artistic licen[sc]e
perl | 3 | perl | (under )?the same terms as perl( itself)?
python-2.0 | 4 | python | python software foundation licen[sc]e( version)? (v ?)?2
python | 3 | python | python software foundation licen[sc]e
python | 3 | psf | psf licen[sc]e
ruby | 3 | ruby | (the )?ruby licen[sc]e
php-3.01 | 4 | php | php licen[sc]e( version)? 3 01
php | 3 | php | (the )?php licen[sc]e
isc | 3 | isc | (the )?isc licen[sc]e
isc | 3 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee
zlib | 3 | zlib | (the )?zlib( libpng)? licen[sc]e
zlib | 3 | misrepresented | the origin of this software must not be misrepresented
libpng | 3 | libpng | libpng licen[sc]e
boost-1.0 | 4 | boost | boost software licen[sc]e( version)? (v ?)?1 0
boost | 3 | boost | boost software licen[sc]e
unlicense | 3 | unlicense | (the )?unlicense
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 3 | wtfpl | wtfpl( version 2| v?2)?
wtfpl | 3 | want | do what the [a-z]+ you want to public licen[sc]e
beerware | 3 | beerware | beerware licen[sc]e
beerware | 3 | beer | the beer ware licen[sc]e
openssl | 3 | openssl | openssl licen[sc]e
openssl | 3 | openssl | openssl toolkit http www openssl org
ssleay | 3 | ssleay | ssleay licen[sc]e
curl | 3 | curl | curl licen[sc]e
postgresql | 3 | postgresql | postgresql licen[sc]e
ncsa | 3 | ncsa | (university of illinois )?ncsa( open source)? licen[sc]e
w3c | 3 | w3c | w3c software( notice and)? licen[sc]e
unicode | 3 | unicode | unicode( inc)? licen[sc]e agreement
icu | 3 | icu | icu licen[sc]e
eupl-1.2 | 4 | eupl | eupl( version)? (v ?)?1 2
eupl-1.1 | 4 | eupl | eupl( version)? (v ?)?1 1
eupl | 3 | european | european union public licen[sc]e
ms-pl | 3 | microsoft | microsoft public licen[sc]e( ms pl)?
ms-rl | 3 | microsoft | microsoft reciprocal licen[sc]e( ms rl)?
ofl-1.1 | 4 | sil | sil open font licen[sc]e( ofl)?( version)? (v ?)?1 1
ofl | 3 | font | (sil )?open font licen[sc]e
ofl | 3 | reserved | with reserved font name
odbl-1.0 | 4 | odbl | odbl( version)? (v ?)?1 0
odbl | 3 | database | (open data commons )?open database licen[sc]e( odbl)?
odc-by | 3 | commons | open data commons attribution licen[sc]e
pddl | 3 | domain | public domain dedication and licen[sc]e( pddl)?
ogl-3.0 | 4 | government | open government licen[sc]e( version)? (v ?)?3( 0)?
ogl | 3 | government | open government licen[sc]e
osl-3.0 | 4 | osl | osl( version)? (v ?)?3 0
osl | 3 | open | open software licen[sc]e( version)?( (v ?)?[123] [01])?
afl-3.0 | 4 | academic | academic free licen[sc]e( version)? (v ?)?3 0
afl | 3 | academic | academic free licen[sc]e
ecl-2.0 | 3 | educational | educational community licen[sc]e( version 2 0)?
nposl | 3 | profit | non profit open software licen[sc]e
qpl | 3 | public | q public licen[sc]e( version 1 0)?
sleepycat | 3 | sleepycat | sleepycat licen[sc]e
vim | 3 | vim | vim licen[sc]e
tcl | 3 | tcl | tcl( tk)? licen[sc]e
lppl-1.3 | 3 | latex | latex project public licen[sc]e( version)?( 1 3c?)?
intel | 3 | intel | intel open source licen[sc]e
cecill | 3 | cecill | cecill( b| c)?( licen[sc]e| free software licen[sc]e)?( agreement)?
upl-1.0 | 3 | permissive | universal permissive licen[sc]e( version)?( (v ?)?1 0)?
blueoak | 3 | oak | blue oak model licen[sc]e( 1 0 0)?
mulan | 3 | mulan | mulan (permissive software|psl)( licen[sc]e)?( v?[12])?
hippocratic | 3 | hippocratic | hippocratic licen[sc]e( 2 1| 3 0)?
json | 3 | evil | the software shall be used for good not evil
openrail | 3 | rail,openrail | (creativeml |bigscience )?(open rail|openrail)( m)?( licen[sc]e)?
llama | 3 | llama | llama( [23]( [0-9])?)? community licen[sc]e( agreement)?
# source available and commercial
sspl-1.0 | 4 | sspl | sspl( version)? (v ?)?1( 0)?
sspl | 3 | server | server side public licen[sc]e
busl-1.1 | 4 | business | business source licen[sc]e( version)? (v ?)?1 1
busl | 3 | business | business source licen[sc]e
elastic-2.0 | 3 | elastic | elastic licen[sc]e( version)?( (v ?)?2 0)?
commons-clause | 3 | clause | commons clause( licen[sc]e condition)?( v1 0)?
polyform | 3 | polyform | polyform (noncommercial|strict|shield|small business|perimeter)( licen[sc]e)?( 1 0 0)?
confluent | 3 | confluent | confluent community licen[sc]e
redis-sal | 3 | redis | redis source available licen[sc]e
eula | 2 | end | end user licen[sc]e agreement
eula | 2 | eula | (this |the )?eula
proprietary | 3 | proprietary | (confidential and proprietary|proprietary and confidential)
proprietary | 2 | proprietary | proprietary licen[sc]e
proprietary | 2 | unauthorized,unauthorised | unauthori[sz]ed (copying|reproduction|distribution|use)( of this [a-z]+)?( via any medium)? is( strictly)? prohibited
commercial | 2 | commercial | commercial licen[sc]e( agreement| is required)?
non-commercial | 2 | commercial | for non commercial (use|purposes)( only)?
non-commercial | 2 | noncommercial | for noncommercial (use|purposes)( only)?
research-only | 2 | research | for( academic or)? research (use|purposes) only
personal-use | 2 | personal | for personal( non commercial)? use only
evaluation | 2 | evaluation | for evaluation (use|purposes) only
no-derivatives | 2 | derivative | no derivative works( are| may be)? (allowed|permitted|made)
no-redistribution | 2 | redistributed | may not be( copied or| published broadcast rewritten or)? redistributed
no-reproduction | 2 | reproduced | (no part of this [a-z]+ may be|may not be) reproduced( in any form| or distributed| stored in a retrieval system)?
no-permission | 2 | permission | without( the)?( express| prior| written){1,3} permission
tdm-reserved | 3 | mining | text and data mining( rights)? (is |are )?(reserved|prohibited|not permitted)
no-ai-training | 3 | training,train | (may not be|not to be) used (for|to)( the)? (training|train) (of )?(any )?(ai|artificial intelligence|machine learning)
# public domain and notices
public-domain | 3 | domain | (released|placed|dedicated) (in|into|to) the public domain
public-domain | 2 | domain | (is|are|in) (in )?the public domain
public-domain | 1 | domain | public domain
us-government | 2 | government | (this is )?a work of the (u s|us|united states) government
fair-use | 2 | fair | fair (use|dealing)( doctrine| notice| act)?
some-rights | 2 | rights | some rights reserved
no-rights | 2 | reserved | no (rights|copyright) reserved
copyleft | 2 | copyleft | (strong |weak )?copyleft( licen[sc]e)?
dual-license | 2 | dual | dual licen[sc]ed( under)?
dual-license | 2 | either | (available|licen[sc]ed) under either( of)?
open-source | 2 | open | open source licen[sc]e[sd]?
open-source | 1 | osi | osi approved( licen[sc]e)?
free-software | 2 | free | this( program)? is free software
warranty | 2 | warranty | (without|with no|absolutely no) warranty( of any kind)?
warranty | 2 | warranty | without any warranty without even the implied warranty of merchantability
warranty | 2 | warranties | without warranties or conditions of any kind
as-is | 2 | provided | (software |work |data )?is provided as is
liability | 2 | liable | in no event shall( the)?( [^ ]+){1,8} be liable
copyright | 2 | copyright | copyright( c)? (19|20)[0-9][0-9]( (19|20)?[0-9][0-9])?
copyright | 1 | copyright | copyright (notice|holders?|owner|law)
copyright | 1 | copyrighted | (is|are) copyrighted( by| material)?
copyright | 1 | © | © (19|20)[0-9][0-9]
copyright | 1 | ©2018,©2019,©2020,©2021,©2022,©2023,©2024,©2025,©2026 | ©20(1[89]|2[0-6])
trademark | 1 | trademark,trademarks | (a )?(registered )?trademarks?( of)?
patent | 1 | patent,patents | patents? (pending|licen[sc]e)
licensed-under | 2 | under | (is |are )?(dual |also )?licen[sc]ed under( the)?( terms of( the)?)?
licensed-under | 2 | under | (released|distributed|available|published) under( the)? (terms|conditions) of
license-text | 1 | license,licence | see( the)? (file )?licen[sc]e( file| txt| md)?( for details| for more information)?
license-text | 1 | license,licence | (a copy of|full text of) (the|this) licen[sc]e
license-text | 1 | license,licence | terms of (the|this) licen[sc]e
attribution | 1 | attribution | attribution( is)? required
# other tongues
gpl | 3 | öffentliche | allgemeine öffentliche gnu lizenz
gpl | 3 | licence | licence publique générale( gnu)?
gpl | 3 | licencia | licencia pública general( de)?( gnu)?
copyright | 2 | alle | alle rechte vorbehalten
copyright | 2 | tous | tous droits réservés
copyright | 2 | todos | todos los derechos reservados
licensed-under | 2 | lizenziert,lizenz | (lizenziert|lizenz) (unter|nach)( der| den)?
licensed-under | 2 | licence | sous( la)? licence
licensed-under | 2 | licencia | bajo( la)?( una)? licencia
public-domain | 2 | gemeinfrei | gemeinfrei
public-domain | 2 | domaine | domaine public
public-domain | 2 | dominio | dominio público
"""


def _rules() -> list[Rule]:
    out = [Rule(label, 1, (phrase.split(" ")[-1],), phrase) for label, phrase in BASE]
    for line in _TEXT.strip().split("\n"):
        if not line.startswith("#"):
            label, priority, gates, pattern = (x.strip() for x in line.split(" | ", 3))
            out.append(Rule(label, int(priority), tuple(gates.split(",")), pattern))
    return out


#: All rules in order; the first len(BASE) are the base phrases.
RULES = _rules()


def wrapped(pattern: str) -> str:
    """The pattern over a text whose words have a space on both sides, so that neighbours share none; group 1 is the match."""
    return " (" + re.sub(r" (\?)?", lambda m: "(?:  )?" if m[1] else "  ", pattern) + ") "
