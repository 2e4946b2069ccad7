"""Signature rules for license texts and notices, in the order in which they are tried.

Fields: label, priority (1 names a license and its version or holds its own wording, 2 names a license or family, 3 is a general
cue), keyword (a word that a document must hold before the pattern is tried), pattern.  Patterns are matched on lower-cased
words joined by single blanks, from a word's start to a word's end: "2.0" is "2 0" there.
"""

RULES = r"""
apache-1.0 | 1 | apache | apache (?:software )?license (?:version |v )?1 0
apache-1.1 | 1 | apache | apache (?:software )?license (?:version |v )?1 1
apache-1.1 | 1 | apache | this product includes software developed by the apache (?:software foundation|group)
apache-2.0 | 1 | apache | apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?
apache-2.0 | 1 | apache | apache 2(?: 0)?(?: licen[sc]ed?)?
apache-2.0 | 1 | apache | asl 2 0 apache
apache-2.0 | 1 | apache | www apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 1 | apache | you may not use this file except in compliance with the license (?:\S+ ){0,8}apache
apache-2.0 | 1 | compliance | you may not use this file except in compliance with the license
apache-2.0 | 1 | governing | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | 1 | spdx | spdx license identifier apache 2 0
apache | 2 | apache | apache (?:software )?licen[sc]e
apache | 2 | apache | apache (?:style|like) licen[sc]e
mit | 1 | mit | (?:the |an? )?mit (?:expat )?licen[sc]e
mit | 1 | mit | mit licensed
mit | 1 | mit | (?:licensed|released|distributed|available) under (?:the )?mit(?: x11)?
mit | 1 | mit | spdx license identifier mit
mit | 1 | mit | opensource org licenses mit(?: license)?(?: php)?
mit | 1 | mit | mit lizenz|licencia mit|licence mit
mit | 1 | expat | (?:the )?expat licen[sc]e
mit | 1 | charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 1 | deal | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit | 1 | portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 1 | mit | mit 0|mit no attribution(?: license)?
x11 | 1 | x11 | (?:the )?x11 licen[sc]e
x11 | 1 | consortium | x consortium licen[sc]e
x11 | 1 | x11 | spdx license identifier x11
bsd-0-clause | 1 | 0bsd | 0bsd
bsd-0-clause | 1 | clause | (?:bsd )?(?:0|zero) clause bsd(?: licen[sc]e)?
bsd-2-clause | 1 | bsd | bsd 2 clause(?: licen[sc]e)?|(?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause | 1 | bsd | (?:simplified|freebsd) bsd licen[sc]e
bsd-2-clause | 1 | freebsd | (?:the )?freebsd licen[sc]e
bsd-2-clause | 1 | bsd | opensource org licenses bsd 2 clause
bsd-2-clause-patent | 1 | bsd | bsd 2 clause plus patent(?: licen[sc]e)?|bsd patent licen[sc]e
bsd-3-clause | 1 | bsd | bsd 3 clause(?: licen[sc]e)?|(?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause | 1 | bsd | (?:new|revised|modified) bsd licen[sc]e
bsd-3-clause | 1 | bsd | opensource org licenses bsd 3 clause
bsd-3-clause | 1 | endorse | neither the names? of (?:\S+ ){1,12}may be used to endorse or promote products derived from this software
bsd-4-clause | 1 | bsd | bsd 4 clause(?: licen[sc]e)?|(?:4|four) clause bsd(?: licen[sc]e)?
bsd-4-clause | 1 | bsd | (?:original|old) bsd licen[sc]e
bsd-4-clause | 1 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | 2 | bsd | (?:the |an? )?bsd(?: style| like)? licen[sc]ed?
bsd | 2 | bsd | (?:licensed|released|distributed|available) under (?:the |an? )?bsd
bsd | 2 | copyright | redistributions? (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice
bsd | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
isc | 1 | isc | (?:the )?isc licen[sc]e|isc licensed
isc | 1 | isc | spdx license identifier isc
isc | 1 | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib | 1 | zlib | (?:the )?zlib(?: libpng)? licen[sc]e
zlib | 1 | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | 1 | libpng | (?:the )?libpng licen[sc]e
bsl-1.0 | 1 | boost | boost software licen[sc]e(?: version)?(?: 1 0)?
bsl-1.0 | 1 | boost | www boost org license 1 0 txt
bsl-1.0 | 1 | spdx | spdx license identifier bsl 1 0
busl-1.1 | 1 | business | business source licen[sc]e(?: version)?(?: 1 1)?
unlicense | 1 | unlicense | (?:the )?unlicense|unlicense org
unlicense | 1 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 1 | wtfpl | wtfpl(?: version 2)?
wtfpl | 1 | fuck | do what the fuck you want to public licen[sc]e
beerware | 1 | beer | (?:the )?beer ?ware licen[sc]e|you can buy me a beer in return
beerware | 1 | beerware | (?:the )?beerware(?: license)?
mpl-1.0 | 1 | mozilla | mozilla public licen[sc]e (?:version |v )?1 0
mpl-1.1 | 1 | mozilla | mozilla public licen[sc]e (?:version |v )?1 1
mpl-2.0 | 1 | mozilla | mozilla public licen[sc]e (?:version |v )?2(?: 0)?
mpl-2.0 | 1 | mpl | mpl (?:version |v )?2 0
mpl-2.0 | 1 | mozilla | (?:http |https )?(?:www )?mozilla org mpl 2 0
mpl-2.0 | 1 | mpl | spdx license identifier mpl 2 0
mpl | 2 | mozilla | mozilla public licen[sc]e
mpl | 2 | mpl | mpl licensed|(?:licensed|released) under (?:the )?mpl
epl-1.0 | 1 | eclipse | eclipse public licen[sc]e (?:version |v )?1 0
epl-2.0 | 1 | eclipse | eclipse public licen[sc]e (?:version |v )?2(?: 0)?
epl-2.0 | 1 | epl | epl 2 0
epl | 2 | eclipse | eclipse public licen[sc]e
edl-1.0 | 1 | eclipse | eclipse distribution licen[sc]e(?: version)?(?: v)?(?: 1 0)?
cpl-1.0 | 1 | common | common public licen[sc]e(?: version)?(?: 1 0)?
ipl-1.0 | 1 | ibm | ibm public licen[sc]e(?: version)?(?: 1 0)?
cddl-1.0 | 1 | cddl | cddl(?: version)?(?: v)? 1 0
cddl-1.1 | 1 | cddl | cddl(?: version)?(?: v)? 1 1
cddl | 2 | cddl | (?:licensed|released|distributed) under (?:the )?cddl|cddl licen[sc]e
cddl | 2 | common | common development and distribution licen[sc]e
cpal-1.0 | 1 | attribution | common public attribution licen[sc]e(?: version)?(?: 1 0)?
eupl-1.1 | 1 | eupl | eupl (?:version |v )?1 1
eupl-1.2 | 1 | eupl | eupl (?:version |v )?1 2
eupl | 2 | european | european union public licen[sc]e
eupl | 2 | eupl | (?:licensed|released) under (?:the )?eupl
cecill-2.1 | 1 | cecill | cecill (?:version |v )?2 1
cecill-b | 1 | cecill | cecill b(?: licen[sc]e)?
cecill-c | 1 | cecill | cecill c(?: licen[sc]e)?
cecill | 2 | cecill | cecill(?: licen[sc]e)?|licence cecill
agpl-3.0 | 1 | affero | (?:gnu )?affero general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?
agpl-3.0 | 1 | agpl | (?:gnu )?agpl ?(?:version |v )?3(?: 0)?(?: only| or later)?
agpl-3.0 | 1 | agplv3 | agplv3
agpl | 2 | affero | (?:gnu )?affero (?:general public )?licen[sc]e
agpl | 2 | agpl | (?:licensed|released|distributed) under (?:the )?(?:gnu )?agpl|gnu agpl
lgpl-2.0 | 1 | library | (?:gnu )?library general public licen[sc]e(?: version)?(?: 2(?: 0)?)?
lgpl-2.1 | 1 | lesser | (?:gnu )?lesser general public licen[sc]e (?:version |v )?2 1(?: or later)?
lgpl-2.1 | 1 | lgpl | (?:gnu )?lgpl ?(?:version |v )?2 1(?: only| or later)?
lgpl-3.0 | 1 | lesser | (?:gnu )?lesser general public licen[sc]e (?:version |v )?3(?: 0)?(?: or later)?
lgpl-3.0 | 1 | lgpl | (?:gnu )?lgpl ?(?:version |v )?3(?: 0)?(?: only| or later)?
lgpl-3.0 | 1 | lgplv3 | lgplv3
lgpl | 2 | lesser | (?:gnu )?lesser general public licen[sc]e
lgpl | 2 | lgpl | gnu lgpl|lgpl licen[sc]e|(?:licensed|released|distributed) under (?:the )?lgpl
gpl-1.0 | 1 | gnu | gnu general public licen[sc]e (?:version |v )?1(?: 0)?
gpl-2.0 | 1 | general | (?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v )?2(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?
gpl-2.0 | 1 | gpl | (?:gnu )?gpl ?(?:version |v )?2(?: 0)?(?: only| or later)?
gpl-2.0 | 1 | gplv2 | gplv2
gpl-3.0 | 1 | general | (?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?
gpl-3.0 | 1 | gpl | (?:gnu )?gpl ?(?:version |v )?3(?: 0)?(?: only| or later)?
gpl-3.0 | 1 | gplv3 | gplv3
gpl-3.0 | 1 | gnu | www gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
gpl | 2 | gnu | gnu general public licen[sc]e
gpl | 2 | gpl | gnu gpl|gpl licen[sc]e|(?:licensed|released|distributed) under (?:the )?gpl
gpl | 2 | warranty | this program is distributed in the hope that it will be useful but without any warranty
gpl | 2 | redistribute | you can redistribute it and or modify it under the terms of the gnu
gpl | 2 | gnu | www gnu org licenses(?: gpl)?
gpl-exception | 1 | classpath | (?:with )?(?:the )?classpath exception
gpl-exception | 1 | exception | (?:gcc runtime library|autoconf|bison|font|linking) exception
gfdl-1.1 | 1 | documentation | (?:gnu )?free documentation licen[sc]e (?:version |v )?1 1
gfdl-1.2 | 1 | documentation | (?:gnu )?free documentation licen[sc]e (?:version |v )?1 2
gfdl-1.3 | 1 | documentation | (?:gnu )?free documentation licen[sc]e (?:version |v )?1 3
gfdl | 2 | documentation | (?:gnu )?free documentation licen[sc]e
gfdl | 2 | gfdl | gfdl
gfdl | 2 | fdl | gnu fdl
cc0-1.0 | 1 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | 1 | creativecommons | creativecommons org publicdomain zero(?: 1 0)?
cc-pdm-1.0 | 1 | mark | public domain mark(?: 1 0)?
cc-by-nc-nd-4.0 | 1 | cc | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 1 | cc | cc by nc nd 3 0
cc-by-nc-nd | 2 | cc | cc by nc nd
cc-by-nc-nd | 2 | noderivs | attribution non ?commercial noderivs(?: \d \d)?
cc-by-nc-nd | 2 | noderivatives | attribution non ?commercial noderivatives(?: \d \d)?(?: international)?
cc-by-nc-sa-4.0 | 1 | cc | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 1 | cc | cc by nc sa 3 0
cc-by-nc-sa | 2 | cc | cc by nc sa
cc-by-nc-sa | 2 | attribution | attribution non ?commercial share ?alike(?: \d \d)?(?: international)?
cc-by-nc-4.0 | 1 | cc | cc by nc 4 0
cc-by-nc-3.0 | 1 | cc | cc by nc 3 0
cc-by-nc-2.0 | 1 | cc | cc by nc 2 0
cc-by-nc | 2 | cc | cc by nc
cc-by-nc | 2 | noncommercial | (?:creative commons )?attribution noncommercial(?: \d \d)?(?: international)?
cc-by-nd-4.0 | 1 | cc | cc by nd 4 0
cc-by-nd-3.0 | 1 | cc | cc by nd 3 0
cc-by-nd | 2 | cc | cc by nd
cc-by-sa-4.0 | 1 | cc | cc by sa 4 0
cc-by-sa-3.0 | 1 | cc | cc by sa 3 0
cc-by-sa-2.5 | 1 | cc | cc by sa 2 5
cc-by-sa-2.0 | 1 | cc | cc by sa 2 0
cc-by-sa | 2 | cc | cc by sa
cc-by-sa | 2 | attribution | (?:creative commons )?attribution share ?alike(?: \d \d)?(?: international)?
cc-by-4.0 | 1 | cc | cc by 4 0
cc-by-3.0 | 1 | cc | cc by 3 0
cc-by-2.5 | 1 | cc | cc by 2 5
cc-by-2.0 | 1 | cc | cc by 2 0
cc-by-4.0 | 1 | creative | creative commons attribution 4 0(?: international)?
cc-by-3.0 | 1 | creative | creative commons attribution 3 0(?: unported)?
cc-by-4.0 | 1 | creativecommons | creativecommons org licenses by 4 0
cc-by-sa-4.0 | 1 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | 1 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | 1 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | 1 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 1 | creativecommons | creativecommons org licenses by nc nd 4 0
cc | 2 | creative | (?:a )?creative commons licen[sc]ed?
cc | 2 | creative | licencia creative commons|creative commons lizenz|licence creative commons
cc | 3 | creativecommons | creativecommons org
odbl-1.0 | 1 | odbl | odbl(?: v?1 0)?
odbl-1.0 | 1 | database | open database licen[sc]e(?: 1 0)?
odc-by-1.0 | 1 | odc | odc by(?: 1 0)?
odc-by-1.0 | 1 | commons | open data commons attribution licen[sc]e
pddl-1.0 | 1 | pddl | pddl(?: 1 0)?
pddl-1.0 | 1 | dedication | open data commons public domain dedication and licen[sc]e
cdla-permissive | 1 | community | community data licen[sc]e agreement permissive(?: 1 0| 2 0)?
cdla-sharing | 1 | community | community data licen[sc]e agreement sharing(?: 1 0)?
ogl-uk-3.0 | 1 | government | open government licen[sc]e v?3 0
ogl-uk | 2 | government | open government licen[sc]e
etalab-2.0 | 1 | ouverte | licence ouverte(?: open licence)?(?: etalab)?(?: version)?(?: 2 0)?
dl-de-by-2.0 | 1 | datenlizenz | datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?
artistic-1.0 | 1 | artistic | artistic licen[sc]e (?:version |v )?1 0
artistic-2.0 | 1 | artistic | artistic licen[sc]e (?:version |v )?2(?: 0)?
artistic | 2 | artistic | (?:the )?artistic licen[sc]e
perl | 2 | perl | (?:under )?the same terms as perl(?: itself)?
psf-2.0 | 1 | python | python software foundation licen[sc]e(?: version)?(?: 2)?
psf-2.0 | 1 | psf | psf licen[sc]e(?: agreement)?
php-3.01 | 1 | php | php licen[sc]e (?:version |v )?3 01
php | 2 | php | (?:the )?php licen[sc]e
ruby | 2 | ruby | (?:the )?ruby licen[sc]e|under the same terms as ruby
tcl | 2 | tcl | tcl tk licen[sc]e|tcl licen[sc]e
openssl | 1 | openssl | openssl licen[sc]e|developed by the openssl project
ssleay | 1 | ssleay | ssleay licen[sc]e|original ssleay licen[sc]e
curl | 1 | curl | curl licen[sc]e
icu | 1 | icu | icu licen[sc]e(?: icu 1 8 1 and later)?
unicode-dfs | 1 | unicode | unicode (?:data files and software )?licen[sc]e(?: agreement)?
w3c | 1 | w3c | w3c (?:software(?: notice)?(?: and)?(?: document)? )?licen[sc]e
postgresql | 1 | postgresql | (?:the )?postgresql licen[sc]e
ncsa | 1 | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
ms-pl | 1 | microsoft | microsoft public licen[sc]e
ms-pl | 1 | ms | ms pl
ms-rl | 1 | microsoft | microsoft reciprocal licen[sc]e
apsl-2.0 | 1 | apple | apple public source licen[sc]e(?: version)?(?: 2 0)?
osl-3.0 | 1 | osl | osl 3 0
osl | 2 | open | open software licen[sc]e(?: version)?(?: 3 0)?
afl-3.0 | 1 | academic | academic free licen[sc]e(?: version)?(?: v)?(?: 3 0)?
ecl-2.0 | 1 | educational | educational community licen[sc]e(?: version)?(?: 2 0)?
ofl-1.1 | 1 | sil | sil open font licen[sc]e(?: version)?(?: 1 1)?
ofl-1.1 | 1 | ofl | ofl 1 1
lppl | 2 | latex | latex project public licen[sc]e(?: version)?(?: 1 3c)?
qpl-1.0 | 1 | public | q public licen[sc]e(?: version)?(?: 1 0)?
sleepycat | 1 | sleepycat | sleepycat licen[sc]e
vim | 1 | vim | (?:the )?vim licen[sc]e
json | 1 | evil | the software shall be used for good not evil
elastic-2.0 | 1 | elastic | elastic licen[sc]e(?: version)?(?: 2 0)?
sspl-1.0 | 1 | server | server side public licen[sc]e(?: version)?(?: v)?(?: 1)?
polyform | 2 | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter)(?: licen[sc]e)?
commons-clause | 1 | commons | commons clause(?: licen[sc]e condition)?
openrail | 2 | openrail | (?:creativeml )?openrail(?: m)?(?: licen[sc]e)?
llama | 1 | llama | llama \d(?: \d)? community licen[sc]e(?: agreement)?
hippocratic | 1 | hippocratic | hippocratic licen[sc]e(?: \d \d)?
public-domain | 2 | domain | (?:released|dedicated|placed) (?:in ?to|to|in) the public domain
public-domain | 3 | domain | public domain
public-domain | 3 | gemeinfrei | gemeinfrei
public-domain | 3 | publico | dominio publico
public-domain | 3 | domaine | domaine public
proprietary | 2 | proprietary | proprietary (?:and confidential|software|licen[sc]e)
proprietary | 2 | redistribution | (?:no|any) (?:unauthori[sz]ed )?(?:copying|redistribution|reproduction) (?:\S+ ){0,6}(?:is )?(?:strictly )?prohibited
proprietary | 3 | permission | may not be reproduced (?:\S+ ){0,8}without (?:\S+ ){0,4}permission
commercial | 3 | commercial | commercial licen[sc]e
as-is | 3 | warranties | provided as is (?:and )?without (?:\S+ ){0,3}warranties
as-is | 3 | warranty | (?:is )?provided (?:\S+ )?as is without warranty of any kind
reserved | 3 | derechos | todos los derechos reservados
reserved | 3 | droits | tous droits reserves
reserved | 3 | rechte | alle rechte vorbehalten
copyright | 3 | copyright | copyright (?:c |holder )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
copyright | 3 | copyrighted | copyrighted (?:material|work)s?
spdx | 3 | spdx | spdx license identifier \S+
"""
