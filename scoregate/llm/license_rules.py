"""Signatures of licenses: an ordered list of hand-written regular expressions over a text's words.

A line is: label, weight, keyword, pattern. Patterns meet lower-case words of letters and digits (and all that isn't ASCII)
that stand one space apart, and begin and end at a word's edge. A pattern can match only where its keyword is part of the
lower-cased text. Rules are in order of priority, earlier ones first; weight says how sure a match is. No pattern is
longer than MOST_WORDS words and none has an open repetition, so a match takes time in proportion to the text."""

from __future__ import annotations

from dataclasses import dataclass

MOST_WORDS = 40


@dataclass(frozen=True)
class Rule:
    label: str
    weight: float
    keyword: str
    pattern: str


#: Phrases that the scan's contract names. They are counted wherever they stand, whatever other rules say.
BASE = (
    Rule("mit", 0.8, "license", "mit license"),
    Rule("apache", 0.8, "license", "apache license"),
    Rule("gpl", 0.8, "license", "general public license"),
)

TEXTS = r"""
mit 1.0 permission permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 0.9 noninfringement the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
x11 1.0 consortium except as contained in this notice the name of the x consortium shall not be used
isc 1.0 permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd 0.9 permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?= the software)
hpnd 1.0 permission permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
bsd-2-clause 0.8 redistribution redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause 1.0 endorse neither the name of(?: the)? [^ ]+(?: [^ ]+){0,6} nor the names of its contributors may be used to endorse or promote products
bsd-3-clause 0.9 endorse may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause 1.0 advertising all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment
bsd-source-code 0.9 redistributions redistributions of source code must retain the above copyright notice
apache-2.0 1.0 apache licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 0.9 compliance you may not use this file except in compliance with the license
apache-1.1 1.0 apache this product includes software developed by the apache software foundation
gpl-2.0-or-later 1.0 gnu under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later 1.0 gnu under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-or-later 1.0 gnu under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later 1.0 gnu under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.0-or-later 1.0 gnu under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
agpl-3.0-or-later 1.0 gnu under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gfdl-1.3-or-later 1.0 gnu under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation
gfdl-1.2-or-later 1.0 gnu under the terms of the gnu free documentation license version 1 2 or any later version published by the free software foundation
gpl 0.7 warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl 0.9 gnu you should have received a copy of the gnu general public license along with this (?:program|software|library|file)
lgpl 0.9 gnu you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|software|library|file)
agpl 0.9 gnu you should have received a copy of the gnu affero general public license along with this (?:program|software|library|file)
mpl-2.0 1.0 mozilla this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-1.1 1.0 mozilla the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 1.0 mozilla the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 1.0 netscape the contents of this file are subject to the netscape public license version 1 1
cddl-1.0 1.0 distribution the contents of this file are subject to the terms of the common development and distribution license
epl-1.0 1.0 eclipse this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 1.0 eclipse this program and the accompanying materials are made available under the terms of the eclipse public license (?:v 2 0|2 0|v2 0|version 2 0)
cpl-1.0 1.0 accompanying this program and the accompanying materials are made available under the terms of the common public license v1 0
bsl-1.0 1.0 boost distributed under the boost software license version 1 0
bsl-1.0 1.0 permission permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib 1.0 warranty this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib 0.9 misrepresented the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense 1.0 encumbered this is free and unencumbered software released into the public domain
wtfpl 1.0 just you just do what the fuck you want to
wtfpl 1.0 fuck do what the fuck you want to public license
beerware 1.0 beer the beer ware license revision 42
cc0-1.0 1.0 waived to the extent possible under law [^ ]+(?: [^ ]+){0,8} has waived all copyright and related or neighboring rights
ofl-1.1 1.0 font this font software is licensed under the sil open font license version 1 1
ofl-1.0 1.0 font this font software is licensed under the sil open font license version 1 0
artistic-1.0 1.0 package the intent of this document is to state the conditions under which a package may be copied
ncsa 1.0 illinois university of illinois ncsa open source license
json 1.0 evil the software shall be used for good not evil
vim 0.9 vim may be distributed under the vim license
ms-pl 0.9 governs this license governs use of the accompanying software if you use the software you accept this license
openssl 1.0 openssl this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 1.0 php this product includes php software freely available from
psf-2.0 1.0 python psf is making python available to licensee on an as is basis
postgresql 1.0 california in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
cecill-2.1 0.9 cecill this software is governed by the cecill license under french law
elastic-2.0 0.9 hosted you may not provide the software to third parties as a hosted or managed service
commons-clause 1.0 grant the license does not grant to you the right to sell the software
proprietary 0.9 confidential (?:proprietary and confidential|confidential and proprietary)
proprietary 0.9 unauthorized unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|work)(?: via any medium)? is strictly prohibited
proprietary 0.8 written no part of this (?:publication|work|book|document) may be reproduced(?: [^ ]+){0,12} without(?: the)? prior written (?:permission|consent)
all-rights-reserved 0.7 reserved all rights reserved
public-domain 0.9 domain (?:released|placed|dedicated|donated) (?:in)?to the public domain
public-domain 0.7 domain (?:is|are) in the public domain
"""

NAMES = r"""
mit-0 1.0 mit mit no attribution(?: licen[sc]e)?
mit-0 0.9 mit mit 0(?: licen[sc]e)?
mit 0.9 mit (?:released|licen[sc]ed|distributed|available|published|covered) under (?:the )?(?:terms of the )?mit(?: x11)?(?: licen[sc]e)?
mit 0.9 mit mit (?:style|x11|expat) licen[sc]e
mit 0.9 expat (?:the )?expat licen[sc]e
mit 0.9 opensource opensource org licenses mit(?: license(?: php)?)?
x11 0.8 x11 (?:the )?x11 licen[sc]e
isc 0.9 isc (?:the )?isc licen[sc]e
isc 0.9 opensource opensource org licenses isc
apache-2.0 1.0 apache (?:the )?apache(?: software)? licen[sc]e(?: version| v)? 2(?: 0)?
apache-2.0 0.9 apache (?:the )?apache(?: software)? licen[sc]e v2(?: 0)?
apache-2.0 0.9 apache apache 2(?: 0)?(?: licen[sc]ed?)?
apache-2.0 1.0 apache www apache org licenses license 2 0
apache-2.0 0.9 opensource opensource org licenses apache 2 0
apache-1.1 1.0 apache (?:the )?apache(?: software)? licen[sc]e(?: version| v)? 1 1
apache-1.0 1.0 apache (?:the )?apache(?: software)? licen[sc]e(?: version| v)? 1 0
apache 0.8 apache (?:released|licen[sc]ed|distributed|available) under (?:the )?(?:terms of the )?apache(?: software)? licen[sc]e
asl-2.0 0.7 asl (?:the )?asl 2(?: 0)?
gpl-1.0 1.0 general (?:the )?(?:gnu )?general public licen[sc]e(?: version| v)? 1(?: 0)?
gpl-2.0 1.0 general (?:the )?(?:gnu )?general public licen[sc]e(?: version| v)? 2(?: 0)?
gpl-2.0 1.0 general (?:the )?(?:gnu )?general public licen[sc]e v2(?: 0)?
gpl-3.0 1.0 general (?:the )?(?:gnu )?general public licen[sc]e(?: version| v)? 3(?: 0)?
gpl-3.0 1.0 general (?:the )?(?:gnu )?general public licen[sc]e v3(?: 0)?
gpl-2.0-or-later 1.0 general (?:the )?(?:gnu )?general public licen[sc]e(?: version| v)? 2(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)(?: version)?
gpl-3.0-or-later 1.0 general (?:the )?(?:gnu )?general public licen[sc]e(?: version| v)? 3(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)(?: version)?
gpl-2.0-only 1.0 only (?:the )?(?:gnu )?general public licen[sc]e(?: version| v)? 2(?: 0)? only
gpl-3.0-only 1.0 only (?:the )?(?:gnu )?general public licen[sc]e(?: version| v)? 3(?: 0)? only
gpl-1.0 0.9 gpl (?:gnu )?gpl ?(?:v|version )?1(?: 0)?
gpl-2.0 0.9 gpl (?:gnu )?gpl ?(?:v|version )?2(?: 0)?
gpl-3.0 0.9 gpl (?:gnu )?gpl ?(?:v|version )?3(?: 0)?
gpl-2.0-or-later 0.9 gpl (?:gnu )?gpl ?(?:v|version )?2(?: 0)? or(?: any)? later
gpl-3.0-or-later 0.9 gpl (?:gnu )?gpl ?(?:v|version )?3(?: 0)? or(?: any)? later
gpl-2.0-classpath 1.0 classpath (?:gpl|general public licen[sc]e)(?: version| v)? 2(?: 0)? with(?: the)? classpath exception
gpl 0.9 gnu (?:the )?gnu general public licen[sc]e
gpl 0.8 gnu (?:the )?gnu gpl
gpl 0.8 gpl (?:released|licen[sc]ed|distributed|available) under (?:the )?(?:terms of the )?gpl
gpl 0.7 gpl (?:the )?gpl licen[sc]e
gpl 0.9 gnu www gnu org licenses gpl(?: \d(?: \d)?)?(?: html| txt)?
gpl-2.0 1.0 gnu www gnu org licenses(?: old licenses)? gpl 2 0(?: html| txt)?
gpl-3.0 1.0 gnu www gnu org licenses gpl 3 0(?: html| txt)?
lgpl-2.0 1.0 library (?:the )?(?:gnu )?library general public licen[sc]e(?: version| v)? 2(?: 0)?
lgpl-2.1 1.0 lesser (?:the )?(?:gnu )?lesser general public licen[sc]e(?: version| v)? 2 1
lgpl-2.1 1.0 lesser (?:the )?(?:gnu )?lesser general public licen[sc]e v2 1
lgpl-3.0 1.0 lesser (?:the )?(?:gnu )?lesser general public licen[sc]e(?: version| v)? 3(?: 0)?
lgpl-3.0 1.0 lesser (?:the )?(?:gnu )?lesser general public licen[sc]e v3(?: 0)?
lgpl 0.9 lesser (?:the )?(?:gnu )?lesser general public licen[sc]e
lgpl 0.9 library (?:the )?(?:gnu )?library general public licen[sc]e
lgpl-2.0 0.9 lgpl (?:gnu )?lgpl ?(?:v|version )?2(?: 0)?
lgpl-2.1 0.9 lgpl (?:gnu )?lgpl ?(?:v|version )?2 1
lgpl-3.0 0.9 lgpl (?:gnu )?lgpl ?(?:v|version )?3(?: 0)?
lgpl 0.8 lgpl (?:the )?(?:gnu )?lgpl(?: licen[sc]e)?
lgpl 0.9 gnu www gnu org licenses lgpl(?: \d(?: \d)?)?(?: html| txt)?
agpl-1.0 1.0 affero (?:the )?affero general public licen[sc]e(?: version| v)? 1(?: 0)?
agpl-3.0 1.0 affero (?:the )?(?:gnu )?affero general public licen[sc]e(?: version| v)? 3(?: 0)?
agpl-3.0 1.0 affero (?:the )?(?:gnu )?affero general public licen[sc]e v3(?: 0)?
agpl 0.9 affero (?:the )?(?:gnu )?affero general public licen[sc]e
agpl-3.0 0.9 agpl (?:gnu )?agpl ?(?:v|version )?3(?: 0)?
agpl 0.8 agpl (?:the )?(?:gnu )?agpl(?: licen[sc]e)?
gfdl-1.1 1.0 documentation (?:the )?(?:gnu )?free documentation licen[sc]e(?: version| v)? 1 1
gfdl-1.2 1.0 documentation (?:the )?(?:gnu )?free documentation licen[sc]e(?: version| v)? 1 2
gfdl-1.3 1.0 documentation (?:the )?(?:gnu )?free documentation licen[sc]e(?: version| v)? 1 3
gfdl 0.9 documentation (?:the )?(?:gnu )?free documentation licen[sc]e
gfdl 0.8 gfdl (?:the )?(?:gnu )?gfdl
0bsd 1.0 bsd (?:zero clause bsd|bsd zero clause|0bsd|bsd 0 clause)(?: licen[sc]e)?
bsd-1-clause 1.0 bsd (?:1 clause bsd|bsd 1 clause|one clause bsd)(?: licen[sc]e)?
bsd-2-clause 1.0 bsd (?:2 clause bsd|bsd 2 clause|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-2-clause 0.9 opensource opensource org licenses bsd 2 clause
bsd-3-clause 1.0 bsd (?:3 clause bsd|bsd 3 clause|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-3-clause 0.9 opensource opensource org licenses bsd 3 clause
bsd-3-clause-clear 1.0 bsd (?:the )?clear bsd licen[sc]e
bsd-4-clause 1.0 bsd (?:4 clause bsd|bsd 4 clause|four clause bsd|original bsd|old bsd)(?: licen[sc]e)?
bsd-2-clause-patent 1.0 bsd bsd(?: 2 clause)? plus patent(?: licen[sc]e)?
bsd 0.8 bsd (?:the )?bsd(?: style| like)? licen[sc]e
bsd 0.8 bsd (?:released|licen[sc]ed|distributed|available) under (?:the )?(?:terms of the )?bsd
mpl-1.0 1.0 mozilla (?:the )?mozilla public licen[sc]e(?: version| v)? 1 0
mpl-1.1 1.0 mozilla (?:the )?mozilla public licen[sc]e(?: version| v)? 1 1
mpl-2.0 1.0 mozilla (?:the )?mozilla public licen[sc]e(?: version| v)? 2(?: 0)?
mpl 0.9 mozilla (?:the )?mozilla public licen[sc]e
mpl-2.0 0.9 mpl mpl ?(?:v|version )?2(?: 0)?
mpl-1.1 0.9 mpl mpl ?(?:v|version )?1 1
mpl-2.0 1.0 mozilla (?:www )?mozilla org mpl 2 0
npl 0.9 netscape (?:the )?netscape public licen[sc]e
epl-1.0 1.0 eclipse (?:the )?eclipse public licen[sc]e(?: version| v)? 1(?: 0)?
epl-2.0 1.0 eclipse (?:the )?eclipse public licen[sc]e(?: version| v)? 2(?: 0)?
epl 0.9 eclipse (?:the )?eclipse public licen[sc]e
edl-1.0 0.9 eclipse (?:the )?eclipse distribution licen[sc]e(?: version| v)? 1 0
epl-1.0 0.8 epl epl ?(?:v|version )?1 0
epl-2.0 0.8 epl epl ?(?:v|version )?2 0
cddl-1.0 1.0 cddl (?:common development and distribution licen[sc]e )?cddl ?(?:v|version )?1 0
cddl-1.1 1.0 cddl (?:common development and distribution licen[sc]e )?cddl ?(?:v|version )?1 1
cddl 0.9 distribution (?:the )?common development and distribution licen[sc]e
cddl 0.8 cddl (?:the )?cddl(?: licen[sc]e)?
cpl-1.0 0.9 common (?:the )?common public licen[sc]e(?: version| v)?(?: 1 0)?
ipl-1.0 0.9 ibm (?:the )?ibm public licen[sc]e(?: version| v)?(?: 1 0)?
cpal-1.0 0.9 attribution (?:the )?common public attribution licen[sc]e(?: version| v)?(?: 1 0)?
eupl-1.0 1.0 union (?:the )?european union public licen[sc]e(?: version| v)? 1 0
eupl-1.1 1.0 union (?:the )?european union public licen[sc]e(?: version| v)? 1 1
eupl-1.2 1.0 union (?:the )?european union public licen[sc]e(?: version| v)? 1 2
eupl 0.9 union (?:the )?european union public licen[sc]e
eupl-1.1 0.9 eupl eupl ?(?:v|version )?1 1
eupl-1.2 0.9 eupl eupl ?(?:v|version )?1 2
eupl 0.8 eupl (?:the )?eupl(?: licen[sc]e)?
artistic-1.0 1.0 artistic (?:the )?(?:perl )?artistic licen[sc]e(?: version| v)? 1(?: 0)?
artistic-2.0 1.0 artistic (?:the )?(?:perl )?artistic licen[sc]e(?: version| v)? 2(?: 0)?
artistic 0.8 artistic (?:the )?(?:perl )?artistic licen[sc]e
perl 0.9 perl (?:under )?the same terms as perl(?: itself)?
psf-2.0 0.9 python (?:the )?python software foundation licen[sc]e(?: version| v)?(?: 2(?: 0)?)?
python 0.8 python (?:the )?python licen[sc]e
ruby 0.9 ruby (?:the )?ruby licen[sc]e
php-3.0 1.0 php (?:the )?php licen[sc]e(?: version| v)? 3 0
php-3.01 1.0 php (?:the )?php licen[sc]e(?: version| v)? 3 01
php 0.8 php (?:the )?php licen[sc]e
postgresql 0.9 postgresql (?:the )?postgresql licen[sc]e
openssl 0.9 openssl (?:the )?openssl licen[sc]e
ssleay 0.9 ssleay (?:the )?(?:original )?ssleay licen[sc]e
sleepycat 0.9 sleepycat (?:the )?sleepycat(?: public)? licen[sc]e
bsl-1.0 1.0 boost (?:the )?boost software licen[sc]e(?: version| v)?(?: 1(?: 0)?)?
zlib 0.9 zlib (?:the )?zlib(?: libpng)? licen[sc]e
libpng 0.9 png (?:the )?(?:png reference library|libpng) licen[sc]e(?: version 2)?
ijg 0.9 jpeg (?:the )?independent jpeg group licen[sc]e
libtiff 0.9 libtiff (?:the )?libtiff licen[sc]e
freetype 0.9 freetype (?:the )?freetype(?: project)? licen[sc]e
curl 0.9 curl (?:the )?curl licen[sc]e
icu 0.9 icu (?:the )?icu licen[sc]e
unicode 0.9 unicode (?:the )?unicode(?: inc)? licen[sc]e(?: agreement)?
vim 0.8 vim (?:the )?vim licen[sc]e
ncsa 0.9 ncsa (?:the )?(?:university of illinois )?ncsa(?: open source)? licen[sc]e
unlicense 0.9 unlicen (?:the )?unlicen[sc]e
wtfpl 0.9 wtfpl (?:the )?wtfpl(?: licen[sc]e)?(?: version 2)?
beerware 0.9 beer (?:the )?beer ?ware licen[sc]e
ms-pl 0.9 microsoft (?:the )?microsoft public licen[sc]e
ms-rl 0.9 microsoft (?:the )?microsoft reciprocal licen[sc]e
ms-rsl 0.8 microsoft (?:the )?microsoft reference source licen[sc]e
ofl-1.0 1.0 font (?:the )?(?:sil )?open font licen[sc]e(?: version| v)? 1 0
ofl-1.1 1.0 font (?:the )?(?:sil )?open font licen[sc]e(?: version| v)? 1 1
ofl 0.9 font (?:the )?(?:sil )?open font licen[sc]e
odbl-1.0 1.0 database (?:the )?open database licen[sc]e(?: version| v)? 1 0
odbl 0.9 database (?:the )?open database licen[sc]e
odbl 0.8 odbl (?:the )?odbl(?: licen[sc]e)?
odc-by 0.9 commons (?:the )?open data commons attribution licen[sc]e
pddl-1.0 0.9 commons (?:the )?open data commons public domain dedication(?: and licen[sc]e)?
cdla-permissive-1.0 1.0 community (?:the )?community data licen[sc]e agreement permissive(?: version)? 1 0
cdla-permissive-2.0 1.0 community (?:the )?community data licen[sc]e agreement permissive(?: version)? 2 0
cdla-sharing-1.0 1.0 community (?:the )?community data licen[sc]e agreement sharing(?: version)? 1 0
ogl-uk-1.0 1.0 government (?:the )?open government licen[sc]e(?: version| v)? 1 0
ogl-uk-2.0 1.0 government (?:the )?open government licen[sc]e(?: version| v)? 2 0
ogl-uk-3.0 1.0 government (?:the )?open government licen[sc]e(?: version| v)? 3 0
ogl-uk 0.9 government (?:the )?open government licen[sc]e
etalab-2.0 0.9 ouverte (?:la )?licence ouverte(?: etalab)?(?: 2 0)?
qpl-1.0 0.9 public (?:the )?q public licen[sc]e(?: version| v)?(?: 1 0)?
w3c 0.9 w3c (?:the )?w3c(?: software)?(?: notice and)? licen[sc]e
zpl-1.1 1.0 zope (?:the )?zope public licen[sc]e(?: version| v)? 1 1
zpl-2.0 1.0 zope (?:the )?zope public licen[sc]e(?: version| v)? 2 0
zpl-2.1 1.0 zope (?:the )?zope public licen[sc]e(?: version| v)? 2 1
zpl 0.9 zope (?:the )?zope public licen[sc]e
afl-2.1 1.0 academic (?:the )?academic free licen[sc]e(?: version| v)? 2 1
afl-3.0 1.0 academic (?:the )?academic free licen[sc]e(?: version| v)? 3 0
afl 0.9 academic (?:the )?academic free licen[sc]e
osl-2.1 1.0 open (?:the )?open software licen[sc]e(?: version| v)? 2 1
osl-3.0 1.0 open (?:the )?open software licen[sc]e(?: version| v)? 3 0
osl 0.9 open (?:the )?open software licen[sc]e
rpl-1.5 0.9 reciprocal (?:the )?reciprocal public licen[sc]e(?: version| v)?(?: 1 5)?
rpsl-1.0 0.9 realnetworks (?:the )?realnetworks public source licen[sc]e
apsl-2.0 0.9 apple (?:the )?apple public source licen[sc]e(?: version| v)?(?: 2 0)?
spl-1.0 0.9 sun (?:the )?sun public licen[sc]e(?: version| v)?(?: 1 0)?
sissl 0.9 sun (?:the )?sun industry standards source licen[sc]e
nasa-1.3 0.9 nasa (?:the )?nasa open source agreement(?: version)?(?: 1 3)?
nokia 0.8 nokia (?:the )?nokia open source licen[sc]e
intel 0.8 intel (?:the )?intel open source licen[sc]e
lppl-1.3c 1.0 latex (?:the )?latex project public licen[sc]e(?: version| v)? 1 3c?
lppl 0.9 latex (?:the )?latex project public licen[sc]e
cecill-b 1.0 cecill (?:the )?cecill b(?: licen[sc]e)?
cecill-c 1.0 cecill (?:the )?cecill c(?: licen[sc]e)?
cecill 0.9 cecill (?:the )?cecill(?: free software)? licen[sc]e(?: agreement)?
mulan-2.0 0.9 mulan (?:the )?mulan permissive software licen[sc]e(?: version| v)?(?: ?2)?
upl-1.0 0.9 universal (?:the )?universal permissive licen[sc]e(?: version| v)?(?: 1 0)?
watcom 0.9 watcom (?:the )?sybase open watcom public licen[sc]e
xfree86 0.9 xfree86 (?:the )?xfree86 licen[sc]e
wxwindows 0.9 wxwindows (?:the )?wxwindows(?: library)? licen[sc]e
tcl 0.8 tcl (?:the )?tcl tk licen[sc]e
imagemagick 0.9 imagemagick (?:the )?imagemagick licen[sc]e
info-zip 0.9 info (?:the )?info zip licen[sc]e
ftl 0.8 ftl (?:the )?ftl licen[sc]e
busl-1.1 1.0 business (?:the )?business source licen[sc]e(?: version| v)? 1 1
busl 0.9 business (?:the )?business source licen[sc]e
sspl-1.0 0.9 server (?:the )?server side public licen[sc]e(?: version| v)?(?: 1)?
elastic-2.0 1.0 elastic (?:the )?elastic licen[sc]e(?: version| v)? ?2(?: 0)?
elastic 0.9 elastic (?:the )?elastic licen[sc]e
commons-clause 0.9 commons (?:the )?commons clause(?: licen[sc]e)?(?: condition)?
polyform-noncommercial-1.0 0.9 polyform (?:the )?polyform noncommercial licen[sc]e(?: 1 0 0)?
polyform-small-business-1.0 0.9 polyform (?:the )?polyform small business licen[sc]e(?: 1 0 0)?
openrail 0.9 rail (?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[sc]e)?
llama-community 0.9 llama (?:the )?llama(?: \d(?: \d)?)? community licen[sc]e(?: agreement)?
cern-ohl 0.9 hardware (?:the )?cern open hardware licen[sc]e(?: version| v)?(?: \d(?: \d)?)?
solderpad 0.9 solderpad (?:the )?solderpad hardware licen[sc]e
tapr-ohl 0.9 tapr (?:the )?tapr open hardware licen[sc]e
blueoak-1.0 0.9 blue (?:the )?blue oak model licen[sc]e(?: 1 0 0)?
hippocratic 0.9 hippocratic (?:the )?hippocratic licen[sc]e(?: version)?(?: \d(?: \d)?)?
parity 0.8 parity (?:the )?parity public licen[sc]e
cc0-1.0 1.0 cc0 cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 1.0 zero (?:the )?creative commons zero(?: v?1 0)?(?: universal)?
cc0-1.0 1.0 creativecommons creativecommons org publicdomain zero 1 0
public-domain 0.9 creativecommons creativecommons org publicdomain mark 1 0
creative-commons 0.7 creative (?:a |the )?creative commons(?: public)? licen[sc]e
"""

#: The usual terms of a creative work's license, each as its short form and as its words.
TERMS = (
    ("by", "attribution"),
    ("by-sa", "attribution share ?alike"),
    ("by-nc", "attribution non ?commercial"),
    ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
)
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Identifiers as they stand in tags, badges and package files.
IDENTIFIERS = """
MIT MIT-0 X11 ISC 0BSD BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause Apache-1.0 Apache-1.1 Apache-2.0 GPL-1.0-only GPL-1.0-or-later
GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only
LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later GFDL-1.2-or-later GFDL-1.3-or-later MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1
EUPL-1.1 EUPL-1.2 Artistic-1.0 Artistic-2.0 BSL-1.0 Zlib Libpng Unlicense WTFPL CC0-1.0 OFL-1.1 ODbL-1.0 PDDL-1.0 PostgreSQL OpenSSL
NCSA MS-PL MS-RL OSL-3.0 AFL-3.0 ZPL-2.1 LPPL-1.3c UPL-1.0 BUSL-1.1 SSPL-1.0 Elastic-2.0 PSF-2.0 Python-2.0 Ruby PHP-3.01 JSON Vim curl
"""


def _lines(block: str) -> list[Rule]:
    found = (line.split(" ", 3) for line in block.strip().splitlines())
    return [Rule(label, float(weight), keyword, pattern) for label, weight, keyword, pattern in found]


def _creative() -> list[Rule]:
    out = []
    for short, words in TERMS:
        spaced = short.replace("-", " ")
        for version in VERSIONS:
            number = version.replace(".", " ")
            label = f"cc-{short}-{version}"
            out.append(
                Rule(
                    label,
                    1.0,
                    "commons",
                    f"(?:the |a )?creative commons {words}(?: international| unported| generic)? {number}(?: international| "
                    f"unported| generic)?(?: public)?(?: licen[sc]e)?"
                )
            )
            out.append(Rule(label, 0.9, "cc", f"cc {spaced}(?: v)? ?{number}(?: licen[sc]e)?"))
            out.append(Rule(label, 1.0, "creativecommons", f"creativecommons org licenses {spaced} {number}"))
        out.append(Rule(f"cc-{short}", 0.8, "commons", f"(?:the |a )?creative commons {words}(?: public)?(?: licen[sc]e)?"))
        out.append(Rule(f"cc-{short}", 0.7, "cc", f"cc {spaced}(?: licen[sc]e)?"))
    return out


def _tags() -> list[Rule]:
    tag = lambda name: name.lower().replace("-", " ").replace(".", " ")
    return [Rule(name.lower(), 1.0, "spdx", f"spdx license identifier {tag(name)}") for name in IDENTIFIERS.split()]


#: All rules, first those of the contract, then from the surest to the most general.
RULES = (*BASE, *_tags(), *_lines(TEXTS), *_creative(), *_lines(NAMES))

#: Some gate is part of every text that any rule can match: parts of words, and short names as words of their own.
GATES = (
    "licen", "permission", "software", "warranty", "redistribution", "domain", "reserved", "copyright", "published", "reproduced", "unauthorized",
    "confidential", "materials", "package", "promote", "waived", "fuck", "misrepresented", "damages", "commons", "opensource", "gnu", "mozilla", "apache",
    "gpl", "bsd", "cddl", "eupl", "cecill", "gfdl", "odbl", "wtfpl", "cc0", "perl", "nasa", "rail", "consortium",
)
SHORT_GATES = ("mit", "cc", "epl", "mpl", "asl")
