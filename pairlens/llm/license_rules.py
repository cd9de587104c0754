"""Hand-written licence signatures over normalised text.

Normalised text has lower-case words with one space between them; dots, hyphens and
quotes are gone ("GPL-2.0+" is "gpl 2 0"). A line is label | priority | keyword | regex;
the keyword must occur for the regex to be tried. Priorities: 4 identifiers, 3 named
versions and sentences of a licence's text, 2 names, 1 hints. A regex matches whole words.
"""

RULES = r"""
gpl-1.0 | 4 | spdx | spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0-only | 4 | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | 4 | spdx | spdx license identifier gpl 2 0 or later
gpl-3.0-only | 4 | spdx | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | 4 | spdx | spdx license identifier gpl 3 0 or later
lgpl-2.0 | 4 | spdx | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | 4 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 4 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | 4 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
apache-1.0 | 4 | spdx | spdx license identifier apache 1 0
apache-1.1 | 4 | spdx | spdx license identifier apache 1 1
apache-2.0 | 4 | spdx | spdx license identifier apache 2 0
mit | 4 | spdx | spdx license identifier mit
mit-0 | 4 | spdx | spdx license identifier mit 0
bsd-1-clause | 4 | spdx | spdx license identifier bsd 1 clause
bsd-2-clause | 4 | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | 4 | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | 4 | spdx | spdx license identifier bsd 4 clause
bsd-0-clause | 4 | spdx | spdx license identifier 0bsd
isc | 4 | spdx | spdx license identifier isc
zlib | 4 | spdx | spdx license identifier zlib
mpl-1.1 | 4 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | 4 | spdx | spdx license identifier mpl 2 0
epl-1.0 | 4 | spdx | spdx license identifier epl 1 0
epl-2.0 | 4 | spdx | spdx license identifier epl 2 0
cddl-1.0 | 4 | spdx | spdx license identifier cddl 1 0
cddl-1.1 | 4 | spdx | spdx license identifier cddl 1 1
boost-1.0 | 4 | spdx | spdx license identifier bsl 1 0
unlicense | 4 | spdx | spdx license identifier unlicense
wtfpl | 4 | spdx | spdx license identifier wtfpl
artistic-2.0 | 4 | spdx | spdx license identifier artistic 2 0
ms-pl | 4 | spdx | spdx license identifier ms pl
python-2.0 | 4 | spdx | spdx license identifier (?:python|psf) 2 0
cc0-1.0 | 4 | spdx | spdx license identifier cc0 1 0
cc-by-4.0 | 4 | spdx | spdx license identifier cc by 4 0
cc-by-sa-4.0 | 4 | spdx | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | 4 | spdx | spdx license identifier cc by nc 4 0
cc-by-nd-4.0 | 4 | spdx | spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0 | 4 | spdx | spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | 4 | spdx | spdx license identifier cc by nc nd 4 0
eupl-1.2 | 4 | spdx | spdx license identifier eupl 1 2
ofl-1.1 | 4 | spdx | spdx license identifier ofl 1 1
gpl-1.0 | 3 | general public license | gnu general public license (?:version |v)1(?: 0)?
gpl-1.0 | 3 | gplv1 | (?:gnu )?gplv1
gpl-2.0-only | 3 | general public license | gnu general public license (?:version |v ?)2(?: 0)?(?: only)?
gpl-2.0-only | 3 | gplv2 | (?:gnu )?gplv2(?: only)?
gpl-2.0-only | 3 | gpl 2 | (?:gnu )?gpl 2 0 only
gpl-2.0-or-later | 3 | general public license | gnu general public license (?:version |v ?)2(?: 0)? or(?: at your option)? (?:any )?later(?: version)?
gpl-2.0-or-later | 3 | either version 2 | gnu general public license as published by the free software foundation either version 2
gpl-2.0-or-later | 3 | gplv2 | (?:gnu )?gplv2 or (?:any )?later
gpl-2.0-or-later | 3 | gpl 2 | (?:gnu )?gpl 2 0 or later
gpl-3.0-only | 3 | general public license | gnu general public license (?:version |v ?)3(?: 0)?(?: only)?
gpl-3.0-only | 3 | gplv3 | (?:gnu )?gplv3(?: only)?
gpl-3.0-only | 3 | gpl 3 | (?:gnu )?gpl 3 0 only
gpl-3.0-or-later | 3 | general public license | gnu general public license (?:version |v ?)3(?: 0)? or(?: at your option)? (?:any )?later(?: version)?
gpl-3.0-or-later | 3 | either version 3 | gnu general public license as published by the free software foundation either version 3
gpl-3.0-or-later | 3 | gplv3 | (?:gnu )?gplv3 or (?:any )?later
gpl-3.0-or-later | 3 | gpl 3 | (?:gnu )?gpl 3 0 or later
gpl | 3 | free software foundation | terms of the gnu general public license as published by the free software foundation
gpl | 3 | general public license | distributed under the terms of the gnu general public license
gpl | 3 | general public license | you should have received a copy of the gnu general public license
gpl | 3 | general public license | see the gnu general public license for more details
gpl-classpath-exception | 3 | classpath | gnu general public license (?:\w+ ){0,6}with (?:the )?classpath exception
gpl-font-exception | 3 | font exception | gnu general public license (?:\w+ ){0,6}with (?:the )?font exception
gpl-linking-exception | 3 | linking exception | gnu general public license (?:\w+ ){0,6}with (?:a )?linking exception
gpl | 2 | gpl | gnu gpl
gpl | 2 | gpl | (?:under|the) gpl license
gpl | 2 | general public license | gnu general public licen[cs]e
gpl | 1 | gpl | licen[cs]ed under (?:the )?gpl
lgpl-2.0 | 3 | library general | gnu library general public license(?: version 2(?: 0)?)?
lgpl-2.1 | 3 | lesser general | gnu lesser general public license (?:version |v ?)2 1(?: only)?
lgpl-2.1-or-later | 3 | either version 2 1 | gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-2.1 | 3 | lgplv2 | (?:gnu )?lgplv2(?: 1)?
lgpl-3.0 | 3 | lesser general | gnu lesser general public license (?:version |v ?)3(?: 0)?(?: only)?
lgpl-3.0-or-later | 3 | either version 3 | gnu lesser general public license as published by the free software foundation either version 3
lgpl-3.0 | 3 | lgplv3 | (?:gnu )?lgplv3
lgpl | 2 | lesser general | gnu lesser general public license
lgpl | 2 | lgpl | (?:gnu )?lgpl license
lgpl | 1 | lgpl | licen[cs]ed under (?:the )?(?:gnu )?lgpl
agpl-3.0 | 3 | affero | gnu affero general public license (?:version |v ?)3(?: 0)?(?: only)?
agpl-3.0-or-later | 3 | affero | gnu affero general public license as published by the free software foundation either version 3
agpl-3.0 | 3 | agplv3 | (?:gnu )?agplv3
agpl-1.0 | 3 | affero | affero general public license version 1
agpl | 2 | affero | (?:gnu )?affero general public license
agpl | 1 | agpl | licen[cs]ed under (?:the )?(?:gnu )?agpl
gfdl-1.1 | 3 | free documentation | gnu free documentation license version 1 1
gfdl-1.2 | 3 | free documentation | gnu free documentation license version 1 2
gfdl-1.3 | 3 | free documentation | gnu free documentation license version 1 3
gfdl | 2 | free documentation | gnu free documentation license
gpl-any | 1 | gnu | gnu public licen[cs]e
apache-1.0 | 3 | apache | apache (?:software )?license (?:version |v ?)1(?: 0)?
apache-1.1 | 3 | apache | apache (?:software )?license (?:version |v ?)1 1
apache-2.0 | 3 | apache | apache (?:software )?license (?:version |v ?)2(?: 0)?
apache-2.0 | 3 | apache | licensed under the apache license version 2 0(?: the license)?
apache-2.0 | 3 | apache | you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0 | 3 | apache org | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 3 | apache | apache 2 0 license
apache-2.0 | 2 | apache | apache license 2 0
apache-2.0 | 2 | asl 2 | asl 2 0
apache | 2 | apache | apache (?:software )?licen[cs]e
apache | 1 | apache | licen[cs]ed under (?:the )?apache
apache-2.0 | 3 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
mit | 3 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 3 | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 3 | mit no attribution | mit no attribution
mit-advertising | 3 | mit | mit license with advertising
mit-x11 | 3 | x11 | x11 license
mit-x11 | 2 | mit x | mit x11?(?: consortium)?(?: license)?
mit | 2 | mit | (?:released|licen[cs]ed|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?mit license
mit | 2 | mit | the mit license(?: mit)?
mit | 2 | expat | expat license
mit | 2 | mit | mit licen[cs]ed?
mit | 2 | opensource org | opensource org licenses mit(?: license)?
mit-feh | 3 | permission is hereby granted | all copies of the software and its documentation and acknowledgment shall be given in the documentation
mit-old-style | 3 | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
hpnd | 3 | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose (?:and|with or) without fee is hereby granted provided that the above copyright notice appear
isc | 3 | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | (?:the )?isc license
bsd-0-clause | 3 | zero clause | (?:bsd )?zero clause (?:bsd )?license
bsd-0-clause | 2 | 0bsd | 0bsd(?: license)?
bsd-1-clause | 2 | 1 clause | bsd 1 clause(?: license)?
bsd-2-clause | 3 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | 2 | 2 clause | (?:bsd 2 clause|2 clause bsd)(?: license)?
bsd-2-clause | 2 | simplified bsd | simplified bsd license
bsd-2-clause-freebsd | 2 | freebsd | freebsd (?:license|copyright)
bsd-2-clause-netbsd | 2 | netbsd | netbsd license
bsd-3-clause | 3 | neither the name | neither the names? of (?:\w+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | 2 | 3 clause | (?:bsd 3 clause|3 clause bsd)(?: license)?
bsd-3-clause | 2 | new bsd | new bsd license
bsd-3-clause | 2 | modified bsd | modified bsd license
bsd-3-clause | 2 | revised bsd | revised bsd license
bsd-3-clause-clear | 3 | clear bsd | (?:the )?clear bsd license
bsd-3-clause-lbnl | 2 | lbnl | lbnl bsd(?: license)?
bsd-3-clause-no-nuclear | 3 | nuclear | not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility
bsd-4-clause | 3 | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | 2 | 4 clause | (?:bsd 4 clause|4 clause bsd)(?: license)?
bsd-4-clause | 2 | original bsd | original bsd license
bsd-4-clause-uc | 3 | regents | regents of the university of california
bsd | 2 | bsd | bsd (?:style )?licen[cs]e
bsd | 1 | bsd | licen[cs]ed under (?:the )?bsd
bsd-protection | 2 | bsd protection | bsd protection license
mpl-1.0 | 3 | mozilla public | mozilla public license (?:version |v ?)1 0
mpl-1.1 | 3 | mozilla public | mozilla public license (?:version |v ?)1 1
mpl-2.0 | 3 | mozilla public | mozilla public license (?:version |v ?)2(?: 0)?
mpl-2.0 | 3 | mozilla public | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 3 | mozilla org | mozilla org mpl 2 0
mpl-2.0-no-copyleft | 3 | incompatible with secondary | incompatible with secondary licenses
mpl | 2 | mozilla public | mozilla public license
npl-1.1 | 3 | netscape public | netscape public license (?:version )?1 1
npl | 2 | netscape public | netscape public license
epl-1.0 | 3 | eclipse public | eclipse public license (?:version |v ?)?1 0
epl-2.0 | 3 | eclipse public | eclipse public license (?:version |v ?)?2 0
epl | 2 | eclipse public | eclipse public license
edl-1.0 | 2 | eclipse distribution | eclipse distribution license(?: v ?1 0)?
cpl-1.0 | 2 | common public | common public license(?: version)?(?: 1 0)?
ipl-1.0 | 2 | ibm public | ibm public license(?: version 1 0)?
cddl-1.0 | 3 | common development | common development and distribution license (?:version )?1 0
cddl-1.1 | 3 | common development | common development and distribution license (?:version )?1 1
cddl | 2 | common development | common development and distribution license
cddl | 2 | cddl | cddl(?: license)?
cpal-1.0 | 2 | common public attribution | common public attribution license(?: version)?(?: 1 0)?
osl-3.0 | 3 | open software license | open software license (?:version |v ?)3 0
osl | 2 | open software license | open software license
afl-3.0 | 3 | academic free | academic free license (?:version |v ?)3 0
afl | 2 | academic free | academic free license
artistic-1.0 | 3 | artistic license | artistic license (?:version )?1 0
artistic-2.0 | 3 | artistic license | artistic license (?:version )?2 0
artistic | 2 | artistic license | (?:the )?artistic license
perl | 2 | perl | same terms as perl(?: 5)? itself
boost-1.0 | 3 | boost software | boost software license (?:version )?1 0
boost-1.0 | 2 | boost software | boost software license
zlib | 3 | altered source versions | altered source versions must be plainly marked as such
zlib | 3 | provided as is without any express | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 2 | zlib | zlib(?: libpng)? license
libpng | 2 | libpng | libpng license
ijg | 3 | independent jpeg group | this software is based in part on the work of the independent jpeg group
openssl | 3 | openssl project | this product includes software developed by the openssl project
openssl | 2 | openssl | (?:the )?openssl license
ssleay | 3 | eric young | this product includes cryptographic software written by eric young
unlicense | 3 | released into the public domain | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | (?:the )?unlicense
wtfpl | 3 | do what the fuck | do what the fuck you want to public license
wtfpl | 2 | wtfpl | wtfpl
beerware | 3 | beer | the beer ?ware license
beerware | 3 | buy me a beer | you can buy me a beer in return
json | 3 | good not evil | the software shall be used for good not evil
postgresql | 2 | postgresql | (?:the )?postgresql license
postgresql | 3 | postgres | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
python-2.0 | 3 | python software foundation | python software foundation license version 2
python-2.0 | 2 | python software foundation | python software foundation license
python-cnri | 2 | cnri | cnri (?:python|open source) license
php-3.01 | 3 | php license | php license version 3 01
php-3.0 | 3 | php license | php license version 3 0
php | 2 | php license | (?:the )?php license
ruby | 2 | ruby | same terms as ruby(?: itself)?
ruby | 2 | ruby license | (?:the )?ruby license
tcl | 2 | tcl | tcl tk license
vim | 2 | vim license | (?:the )?vim license
ncsa | 2 | ncsa | (?:university of illinois )?ncsa open source license
llvm-exception | 3 | llvm | llvm exceptions?(?: to the apache)?
w3c | 2 | w3c | w3c software (?:notice and )?license
x-net | 2 | x net | x net license
xfree86-1.1 | 2 | xfree86 | xfree86 license(?: 1 1)?
zpl-2.1 | 2 | zope public | zope public license(?: version)?(?: 2 1)?
ms-pl | 2 | microsoft public | microsoft public license(?: ms pl)?
ms-rl | 2 | microsoft reciprocal | microsoft reciprocal license(?: ms rl)?
ms-limited | 2 | microsoft limited | microsoft limited public license
nasa-1.3 | 2 | nasa open | nasa open source agreement(?: version)?(?: 1 3)?
apsl-2.0 | 2 | apple public | apple public source license(?: version)?(?: 2 0)?
sgi-b-2.0 | 2 | sgi free | sgi free software license b(?: version 2 0)?
sissl | 2 | sun industry | sun industry standards source license
qpl-1.0 | 2 | q public | (?:the )?q public license(?: version 1 0)?
rpl-1.5 | 2 | reciprocal public | reciprocal public license(?: version)?(?: 1 5)?
sleepycat | 2 | sleepycat | (?:the )?sleepycat license
eupl-1.1 | 3 | european union public | european union public licen[cs]e (?:version |v ?)?1 1
eupl-1.2 | 3 | european union public | european union public licen[cs]e (?:version |v ?)?1 2
eupl | 2 | european union public | european union public licen[cs]e
cecill-2.1 | 3 | cecill | cecill (?:version )?2 1
cecill-b | 2 | cecill | cecill b(?: license)?
cecill-c | 2 | cecill | cecill c(?: license)?
cecill | 2 | cecill | cecill(?: license)?
mulanpsl-2.0 | 2 | mulan | mulan (?:psl|permissive software license)(?: v ?2)?
upl-1.0 | 2 | universal permissive | universal permissive license(?: v ?1 0)?
ecl-2.0 | 2 | educational community | educational community license(?: version 2 0)?
bittorrent | 2 | bittorrent | bittorrent open source license
blueoak-1.0.0 | 2 | blue oak | blue oak model license(?: 1 0 0)?
ofl-1.0 | 3 | open font | (?:sil )?open font license (?:version )?1 0
ofl-1.1 | 3 | open font | (?:sil )?open font license (?:version )?1 1
ofl | 2 | open font | (?:sil )?open font license
cc0-1.0 | 3 | cc0 | cc0 (?:1 0|universal)(?: universal)?
cc0-1.0 | 3 | creative commons zero | creative commons zero(?: v ?1 0)?(?: universal)?
cc0 | 2 | cc0 | cc0
cc-by-1.0 | 3 | cc by | cc by 1 0
cc-by-2.0 | 3 | cc by | cc by 2 0
cc-by-2.5 | 3 | cc by | cc by 2 5
cc-by-3.0 | 3 | cc by | cc by 3 0
cc-by-4.0 | 3 | cc by | cc by 4 0
cc-by-sa-1.0 | 3 | cc by sa | cc by sa 1 0
cc-by-sa-2.0 | 3 | cc by sa | cc by sa 2 0
cc-by-sa-2.5 | 3 | cc by sa | cc by sa 2 5
cc-by-sa-3.0 | 3 | cc by sa | cc by sa 3 0
cc-by-sa-4.0 | 3 | cc by sa | cc by sa 4 0
cc-by-nc-2.0 | 3 | cc by nc | cc by nc 2 0
cc-by-nc-2.5 | 3 | cc by nc | cc by nc 2 5
cc-by-nc-3.0 | 3 | cc by nc | cc by nc 3 0
cc-by-nc-4.0 | 3 | cc by nc | cc by nc 4 0
cc-by-nd-3.0 | 3 | cc by nd | cc by nd 3 0
cc-by-nd-4.0 | 3 | cc by nd | cc by nd 4 0
cc-by-nc-sa-2.0 | 3 | cc by nc sa | cc by nc sa 2 0
cc-by-nc-sa-3.0 | 3 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa-4.0 | 3 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-nd-3.0 | 3 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd-4.0 | 3 | cc by nc nd | cc by nc nd 4 0
cc-by-sa | 2 | cc by sa | cc by sa
cc-by-nc | 2 | cc by nc | cc by nc
cc-by-nd | 2 | cc by nd | cc by nd
cc-by-nc-sa | 2 | cc by nc sa | cc by nc sa
cc-by-nc-nd | 2 | cc by nc nd | cc by nc nd
cc-by-4.0 | 3 | creative commons attribution | creative commons attribution 4 0(?: international)?(?: license)?
cc-by-3.0 | 3 | creative commons attribution | creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-sa-4.0 | 3 | sharealike | creative commons attribution sharealike 4 0(?: international)?(?: license)?
cc-by-sa-3.0 | 3 | sharealike | creative commons attribution sharealike 3 0(?: unported)?(?: license)?
cc-by-sa | 2 | sharealike | creative commons attribution share ?alike(?: license)?
cc-by-nc-4.0 | 3 | noncommercial | creative commons attribution non ?commercial 4 0(?: international)?(?: license)?
cc-by-nc | 2 | commercial | creative commons attribution non ?commercial(?: license)?
cc-by-nc-sa-4.0 | 3 | noncommercial | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: license)?
cc-by-nc-nd-4.0 | 3 | noderiv | creative commons attribution non ?commercial noderiv(?:ative)?s 4 0(?: international)?(?: license)?
cc-by-nd | 2 | noderiv | creative commons attribution noderiv(?:ative)?s(?: license)?
cc-by | 2 | creative commons attribution | creative commons attribution(?: license)?
cc-by-4.0 | 3 | creativecommons | creativecommons org licenses by 4 0
cc-by-sa-4.0 | 3 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 3 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | 3 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | 3 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 3 | creativecommons | creativecommons org licenses by nc nd 4 0
cc0-1.0 | 3 | creativecommons | creativecommons org publicdomain zero 1 0
cc | 1 | creative commons | creative commons licen[cs]ed?
odbl-1.0 | 2 | open database | open database license(?: odbl)?(?: v ?1 0)?
pddl-1.0 | 2 | public domain dedication | public domain dedication and license(?: v ?1 0)?
odc-by-1.0 | 2 | open data commons | open data commons attribution license(?: v ?1 0)?
cdla-permissive | 2 | community data license | community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | 2 | community data license | community data license agreement sharing(?: version 1 0)?
openrail | 2 | openrail | (?:bigscience |creativeml )?open ?rail(?: m)?(?: license)?
rail | 2 | responsible ai | responsible ai licen[cs]e
llama-2 | 2 | llama 2 community | llama 2 community license(?: agreement)?
llama-3 | 2 | llama 3 | (?:meta )?llama 3(?: \d)? community license(?: agreement)?
gemma | 2 | gemma terms | gemma terms of use
sspl-1.0 | 2 | server side public | server side public license(?: v ?1)?
elastic-2.0 | 2 | elastic license | elastic license(?: 2 0)?
bsl-1.1 | 2 | business source | business source license(?: 1 1)?
commons-clause | 2 | commons clause | commons clause(?: license condition)?
polyform-noncommercial | 2 | polyform | polyform noncommercial license(?: 1 0 0)?
polyform-small-business | 2 | polyform | polyform small business license(?: 1 0 0)?
oracle-bcl | 2 | oracle binary | oracle binary code license(?: agreement)?
public-domain | 2 | public domain | (?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain | 1 | public domain | in the public domain
all-rights-reserved | 1 | all rights reserved | all rights reserved
proprietary | 2 | proprietary | proprietary and confidential
proprietary | 2 | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
as-is | 1 | provided as is | (?:is )?provided as is without warranty of any kind
unknown-license | 1 | license | see (?:the )?(?:accompanying )?license(?: txt| md)? (?:file )?for (?:more )?(?:details|information)
unknown-license | 1 | license | licensed under the terms of the license
"""


def rules() -> list[tuple[str, int, str, str]]:
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keyword, regex = (part.strip() for part in line.split(" | "))
        out.append((label, int(priority), keyword, regex))
    return out
