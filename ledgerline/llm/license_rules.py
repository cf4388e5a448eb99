"""Signature rules of license scans: regular expressions over lower-case words joined by single spaces, written by hand.

A line holds label, priority, confidence, keywords (a match holds one of those between bars) and pattern.  Names and
identifiers come first, then headers, then sentences of the license texts themselves.
"""

RULES = r"""
mit | 3 | 0.8 | mit | (?:the )?mit licen[sc]e
mit | 5 | 1.0 | mit | (?:re|sub)?licensed under (?:the )?(?:terms of )?(?:the )?mit(?: licen[sc]e)?
mit | 6 | 1.0 | spdx | spdx license identifier mit
mit | 4 | 0.9 | mit | licen[sc]e(?: type| name| is)? mit
mit | 5 | 1.0 | opensource | opensource org licenses mit
mit | 4 | 0.9 | expat | (?:the )?expat licen[sc]e
mit | 6 | 1.0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 5 | 0.9 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | 5 | 0.9 | copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 6 | 1.0 | mit | (?:mit 0 licen[sc]e|spdx license identifier mit 0|mit no attribution licen[sc]e)
x11 | 4 | 0.9 | x11 | (?:the )?x11 licen[sc]e
x11 | 5 | 0.9 | x consortium | the name of the x consortium shall not be used in advertising (?:[^ ]+ ){1,12}written authorization from the x consortium copyright
apache | 2 | 0.7 | apache | (?:the )?apache licen[sc]e
apache-1.0 | 5 | 0.9 | apache | apache(?: software)? licen[sc]e(?: version| v)? 1 0
apache-1.1 | 5 | 0.9 | apache | apache(?: software)? licen[sc]e(?: version| v)? 1 1
apache-2.0 | 5 | 1.0 | apache | apache(?: software)? licen[sc]e(?: version| v)? 2(?: 0)?
apache-2.0 | 6 | 1.0 | apache | licensed under the apache license version 2 0
apache-2.0 | 6 | 1.0 | spdx | spdx license identifier apache 2 0
apache-2.0 | 4 | 0.9 | apache | licen[sc]e(?: type| name| is)? apache 2(?: 0)?
apache-2.0 | 5 | 1.0 | apache | licensed under (?:the )?apache 2(?: 0)?
apache-2.0 | 5 | 1.0 | apache | apache org licenses license 2 0
apache-2.0 | 4 | 0.9 | apache | asl 2 0 apache licen[sc]e
apache-2.0 | 5 | 1.0 | licensed to the apache | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | 5 | 0.9 | you may not use this file | you may not use this file except in compliance with the license
apache-2.0 | 4 | 0.8 | as is basis | distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-1.1 | 5 | 0.9 | apache software foundation | this product includes software developed by the apache software foundation (?:[^ ]+ ){0,6}licen[sc]e
gpl | 3 | 0.8 | general public license | (?:gnu )?general public license
gpl | 3 | 0.8 | gpl | (?:the )?(?:gnu )?gpl licen[sc]e
gpl | 4 | 0.9 | gpl | (?:re|sub)?licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl-1.0 | 5 | 1.0 | general public license | (?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?1
gpl-2.0 | 5 | 1.0 | general public license | (?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2
gpl-3.0 | 5 | 1.0 | general public license | (?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3
gpl-2.0 | 5 | 1.0 | gpl | (?:re|sub)?licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl ?v?2(?: 0)?
gpl-3.0 | 5 | 1.0 | gpl | (?:re|sub)?licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl ?v?3(?: 0)?
gpl-2.0 | 4 | 0.9 | gpl | licen[sc]e(?: type| name| is)? (?:gnu )?gpl ?v?2(?: 0)?
gpl-3.0 | 4 | 0.9 | gpl | licen[sc]e(?: type| name| is)? (?:gnu )?gpl ?v?3(?: 0)?
gpl-2.0 | 6 | 1.0 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 | 6 | 1.0 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
gpl-1.0 | 6 | 1.0 | spdx | spdx license identifier gpl 1 0(?: only| or later)?
gpl | 4 | 0.9 | general public license | you should have received a copy of the gnu general public license
gpl | 4 | 0.9 | free software | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 4 | 0.8 | general public license | gnu org licenses (?:old licenses )?gpl(?: 2 0| 3 0)? html general public license
gpl-3.0 | 5 | 0.9 | you may convey | you may convey verbatim copies of the program s source code (?:[^ ]+ ){1,30}copyright notice
gpl-2.0 | 5 | 0.9 | verbatim copies | you may copy and distribute verbatim copies of the program s source code (?:[^ ]+ ){1,30}copyright notice
gpl-classpath | 6 | 1.0 | classpath | (?:gnu )?general public license (?:[^ ]+ ){0,6}(?:with )?(?:the )?classpath exception
lgpl | 4 | 0.8 | general public license | (?:gnu )?(?:lesser|library) general public license
lgpl-2.0 | 5 | 1.0 | library general public license | (?:gnu )?library general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?: 0)?
lgpl-2.1 | 5 | 1.0 | lesser general public license | (?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?: 1)?
lgpl-3.0 | 5 | 1.0 | lesser general public license | (?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3
lgpl-2.1 | 5 | 0.9 | lgpl | (?:re|sub)?licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl ?v?2(?: 1)?
lgpl-3.0 | 5 | 0.9 | lgpl | (?:re|sub)?licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl ?v?3
lgpl | 4 | 0.8 | lgpl | (?:gnu )?lgpl licen[sc]e
lgpl-2.1 | 6 | 1.0 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 6 | 1.0 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
agpl | 4 | 0.8 | affero | (?:gnu )?affero general public license
agpl-3.0 | 5 | 1.0 | affero | (?:gnu )?affero general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3
agpl-3.0 | 5 | 0.9 | agpl | (?:re|sub)?licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl(?: ?v?3)?
agpl-3.0 | 4 | 0.8 | agpl | (?:gnu )?agpl(?: ?v?3)? licen[sc]e
agpl-3.0 | 6 | 1.0 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
gfdl | 4 | 0.9 | free documentation | (?:gnu )?free documentation license
gfdl | 5 | 1.0 | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 4 | 0.8 | gfdl | (?:the )?gfdl licen[sc]e
gfdl-1.3 | 5 | 1.0 | free documentation | (?:gnu )?free documentation license version 1 3
bsd | 3 | 0.7 | bsd | (?:the )?bsd(?: style)? licen[sc]e
bsd | 4 | 0.9 | bsd | (?:re|sub)?licensed under (?:the )?(?:terms of )?(?:the )?bsd(?: style)?(?: licen[sc]e)?
bsd | 5 | 0.9 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd | 4 | 0.8 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 4 | 0.8 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | 6 | 1.0 | endorse or promote | neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 6 | 1.0 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | 5 | 1.0 | bsd | (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd) licen[sc]e
bsd-3-clause | 5 | 1.0 | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[sc]e
bsd-4-clause | 5 | 1.0 | bsd | (?:original bsd|old bsd|bsd 4 clause|4 clause bsd) licen[sc]e
bsd-2-clause | 6 | 1.0 | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | 6 | 1.0 | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | 6 | 1.0 | spdx | spdx license identifier bsd 4 clause
bsd-3-clause-clear | 6 | 1.0 | clear bsd | (?:the )?clear bsd licen[sc]e
bsd-source-code | 5 | 0.8 | bsd source | bsd source code licen[sc]e
0bsd | 5 | 1.0 | bsd | (?:0bsd|zero clause bsd|bsd zero clause) licen[sc]e
0bsd | 6 | 1.0 | spdx | spdx license identifier 0bsd
bsd-patent | 5 | 0.9 | bsd | bsd (?:2 clause )?plus patent licen[sc]e
isc | 4 | 0.9 | isc | (?:the )?isc licen[sc]e
isc | 6 | 1.0 | spdx | spdx license identifier isc
isc | 5 | 0.9 | permission to use copy | permission to use copy modify and or distribute this software for any purpose
isc | 5 | 0.9 | isc disclaims | isc disclaims all warranties with regard to this software
isc | 5 | 0.9 | consortium | internet (?:systems|software) consortium licen[sc]e
hpnd | 5 | 0.9 | permission to use copy | permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted
ntp | 5 | 0.9 | ntp | ntp licen[sc]e
mpl | 3 | 0.8 | mozilla public | mozilla public license
mpl-1.0 | 5 | 1.0 | mozilla public | mozilla public license(?: version| v)? 1 0
mpl-1.1 | 5 | 1.0 | mozilla public | mozilla public license(?: version| v)? 1 1
mpl-2.0 | 5 | 1.0 | mozilla public | mozilla public license(?: version| v)? 2(?: 0)?
mpl-2.0 | 6 | 1.0 | spdx | spdx license identifier mpl 2 0
mpl-1.1 | 6 | 1.0 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | 6 | 1.0 | source code form is subject | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 5 | 0.9 | mozilla public | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | 4 | 0.9 | mpl | (?:re|sub)?licensed under (?:the )?mpl ?v?2(?: 0)?
npl-1.1 | 5 | 0.9 | netscape public | netscape public license(?: version 1 1)?
epl | 3 | 0.8 | eclipse public | eclipse public license
epl-1.0 | 5 | 1.0 | eclipse public | eclipse public license(?: version| v)? 1(?: 0)?
epl-2.0 | 5 | 1.0 | eclipse public | eclipse public license(?: version| v)? 2(?: 0)?
epl-1.0 | 6 | 1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | 6 | 1.0 | spdx | spdx license identifier epl 2 0
edl-1.0 | 5 | 0.9 | eclipse distribution | eclipse distribution license(?: version| v)?(?: 1 0)?
cddl-1.0 | 5 | 0.9 | common development | common development and distribution license(?: cddl)?(?: version 1 0)?
cddl-1.1 | 6 | 1.0 | common development | common development and distribution license(?: cddl)? version 1 1
cddl-1.0 | 4 | 0.8 | cddl | cddl(?: version)?(?: 1 0)? licen[sc]e
cddl-1.0 | 6 | 1.0 | spdx | spdx license identifier cddl 1 0
cpl-1.0 | 5 | 0.9 | common public | common public license(?: version| v)?(?: 1 0)?
ipl-1.0 | 5 | 0.9 | ibm public | ibm public license(?: version| v)?(?: 1 0)?
cpal-1.0 | 5 | 0.9 | common public attribution | common public attribution license(?: version 1 0)?
cecill-2.1 | 5 | 0.9 | cecill | cecill(?: free software)? licen[sc]e(?: agreement)?(?: version 2 1)?
cecill-b | 6 | 0.9 | cecill b | cecill b(?: free software)? licen[sc]e
cecill-c | 6 | 0.9 | cecill c | cecill c(?: free software)? licen[sc]e
eupl-1.1 | 6 | 1.0 | european union public | european union public licen[sc]e(?: version| v)? 1 1
eupl-1.2 | 6 | 1.0 | european union public | european union public licen[sc]e(?: version| v)? 1 2
eupl | 4 | 0.8 | european union public | european union public licen[sc]e
eupl | 4 | 0.8 | eupl | licensed under (?:the )?eupl
ms-pl | 5 | 1.0 | microsoft public | microsoft public license(?: ms pl)?
ms-rl | 5 | 1.0 | microsoft reciprocal | microsoft reciprocal license(?: ms rl)?
ms-pl | 6 | 1.0 | spdx | spdx license identifier ms pl
ms-rl | 6 | 1.0 | spdx | spdx license identifier ms rl
ms-lpl | 5 | 0.9 | microsoft limited public | microsoft limited public license
artistic | 3 | 0.8 | artistic | (?:the )?artistic license
artistic-1.0 | 5 | 1.0 | artistic | artistic license 1 0
artistic-2.0 | 5 | 1.0 | artistic | artistic license 2(?: 0)?
artistic-2.0 | 6 | 1.0 | spdx | spdx license identifier artistic 2 0
clarified-artistic | 5 | 0.9 | clarified artistic | clarified artistic license
perl | 4 | 0.8 | perl | (?:same licen[sc]e as perl|perl(?: s)? licen[sc]e)
zlib | 4 | 0.9 | zlib | (?:the )?zlib(?: libpng)? licen[sc]e
zlib | 6 | 1.0 | spdx | spdx license identifier zlib
zlib | 5 | 0.9 | express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 5 | 0.9 | permission is granted to anyone | permission is granted to anyone to use this software for any purpose including commercial applications
libpng | 5 | 0.9 | png | (?:png reference library|libpng) licen[sc]e(?: version 2)?
boost-1.0 | 5 | 1.0 | boost software | boost software license(?: version| v)?(?: 1 0)?
boost-1.0 | 6 | 1.0 | spdx | spdx license identifier bsl 1 0
boost-1.0 | 4 | 0.9 | boost | boost licen[sc]e(?: 1 0)?
unlicense | 5 | 1.0 | unlicense | (?:the )?unlicense
unlicense | 5 | 1.0 | public domain | this is free and unencumbered software released into the public domain
wtfpl | 5 | 1.0 | what the | do what the (?:fuck|f u c k) you want to public license
wtfpl | 4 | 0.9 | wtfpl | (?:the )?wtfpl licen[sc]e
beerware | 4 | 0.9 | beer | (?:the )?beer ?ware licen[sc]e
cc0-1.0 | 5 | 1.0 | creative commons | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?(?: public domain dedication| licen[sc]e)
cc0-1.0 | 6 | 1.0 | spdx | spdx license identifier cc0 1 0
cc0-1.0 | 4 | 0.9 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication| licen[sc]e)
cc-by | 4 | 0.8 | creative commons | creative commons attribution licen[sc]e
cc-by-1.0 | 5 | 0.9 | creative commons | creative commons attribution 1 0(?: generic)? licen[sc]e
cc-by-2.0 | 5 | 0.9 | creative commons | creative commons attribution 2 0(?: generic)? licen[sc]e
cc-by-2.5 | 5 | 0.9 | creative commons | creative commons attribution 2 5(?: generic)? licen[sc]e
cc-by-3.0 | 5 | 0.9 | creative commons | creative commons attribution 3 0(?: unported)? licen[sc]e
cc-by-4.0 | 5 | 0.9 | creative commons | creative commons attribution 4 0(?: international)?(?: public)? licen[sc]e
cc-by-4.0 | 5 | 0.9 | cc by 4 0 | cc by 4 0
cc-by-3.0 | 5 | 0.9 | cc by 3 0 | cc by 3 0
cc-by-2.0 | 5 | 0.9 | cc by 2 0 | cc by 2 0
cc-by | 3 | 0.7 | cc by | (?:licensed under |licen[sc]e )(?:a |the )?cc by
cc-by-sa | 4 | 0.8 | creative commons | creative commons attribution share ?alike licen[sc]e
cc-by-sa-3.0 | 5 | 0.9 | creative commons | creative commons attribution share ?alike 3 0(?: unported)? licen[sc]e
cc-by-sa-4.0 | 5 | 0.9 | creative commons | creative commons attribution share ?alike 4 0(?: international)?(?: public)? licen[sc]e
cc-by-sa-4.0 | 6 | 0.9 | cc by sa 4 0 | cc by sa 4 0
cc-by-sa-3.0 | 6 | 0.9 | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-2.5 | 6 | 0.9 | cc by sa 2 5 | cc by sa 2 5
cc-by-sa-2.0 | 6 | 0.9 | cc by sa 2 0 | cc by sa 2 0
cc-by-nc | 4 | 0.8 | creative commons | creative commons attribution non ?commercial licen[sc]e
cc-by-nc-3.0 | 5 | 0.9 | creative commons | creative commons attribution non ?commercial 3 0(?: unported)? licen[sc]e
cc-by-nc-4.0 | 5 | 0.9 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?(?: public)? licen[sc]e
cc-by-nc-4.0 | 6 | 0.9 | cc by nc 4 0 | cc by nc 4 0
cc-by-nc-3.0 | 6 | 0.9 | cc by nc 3 0 | cc by nc 3 0
cc-by-nc-2.0 | 6 | 0.9 | cc by nc 2 0 | cc by nc 2 0
cc-by-nd | 4 | 0.8 | creative commons | creative commons attribution no ?deriv(?:atives|s)? licen[sc]e
cc-by-nd-4.0 | 6 | 0.9 | cc by nd 4 0 | cc by nd 4 0
cc-by-nd-3.0 | 6 | 0.9 | cc by nd 3 0 | cc by nd 3 0
cc-by-nd-4.0 | 5 | 0.9 | creative commons | creative commons attribution no ?deriv(?:atives|s)? 4 0(?: international)? licen[sc]e
cc-by-nc-sa | 4 | 0.8 | creative commons | creative commons attribution non ?commercial share ?alike licen[sc]e
cc-by-nc-sa-4.0 | 5 | 0.9 | creative commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)? licen[sc]e
cc-by-nc-sa-3.0 | 5 | 0.9 | creative commons | creative commons attribution non ?commercial share ?alike 3 0(?: unported)? licen[sc]e
cc-by-nc-sa-4.0 | 6 | 0.9 | cc by nc sa 4 0 | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 6 | 0.9 | cc by nc sa 3 0 | cc by nc sa 3 0
cc-by-nc-nd | 4 | 0.8 | creative commons | creative commons attribution non ?commercial no ?deriv(?:atives|s)? licen[sc]e
cc-by-nc-nd-4.0 | 5 | 0.9 | creative commons | creative commons attribution non ?commercial no ?deriv(?:atives|s)? 4 0(?: international)?(?: public)? licen[sc]e
cc-by-nc-nd-4.0 | 6 | 0.9 | cc by nc nd 4 0 | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 6 | 0.9 | cc by nc nd 3 0 | cc by nc nd 3 0
cc | 3 | 0.7 | creative commons | (?:a |the )?creative commons licen[sc]e
cc | 4 | 0.8 | creativecommons | creativecommons org licenses
cc-pd | 5 | 0.9 | creativecommons | creativecommons org publicdomain (?:zero 1 0|mark 1 0) domain
ofl-1.1 | 5 | 1.0 | open font | (?:sil )?open font license(?: version| v)?(?: 1 1)?
ofl-1.1 | 6 | 1.0 | spdx | spdx license identifier ofl 1 1
ufl-1.0 | 5 | 0.9 | ubuntu font | ubuntu font licen[sc]e(?: version)?(?: 1 0)?
postgresql | 5 | 1.0 | postgresql | (?:the )?postgresql licen[sc]e
python-2.0 | 5 | 1.0 | python software | python software foundation license(?: version 2)?
python-2.0 | 4 | 0.9 | psf | psf licen[sc]e(?: agreement)?
cnri-python | 5 | 0.9 | cnri | cnri(?: open source)?(?: gpl compatible)? license agreement
openssl | 5 | 0.9 | openssl | openssl licen[sc]e
openssl | 5 | 0.9 | openssl project | this product includes software developed by the openssl project for use in the openssl toolkit (?:[^ ]+ ){0,6}licen[sc]e
ssleay | 5 | 0.9 | ssleay | (?:original )?ssleay licen[sc]e
php-3.01 | 5 | 0.9 | php | (?:the )?php license(?: version)?(?: 3 01)?
ruby | 4 | 0.9 | ruby | (?:the )?ruby(?: s)? licen[sc]e
vim | 4 | 0.9 | vim | (?:the )?vim licen[sc]e
ncsa | 5 | 0.9 | ncsa | (?:university of illinois )?ncsa(?: open source)? license
tcl | 4 | 0.9 | tcl | tcl tk licen[sc]e
curl | 4 | 0.9 | curl | curl licen[sc]e
icu | 4 | 0.9 | icu | icu licen[sc]e
unicode | 5 | 0.9 | unicode | unicode(?: inc)? license agreement(?: data files and software)?
w3c | 5 | 0.9 | w3c | w3c software(?: notice)? and(?: document)? licen[sc]e
json | 5 | 0.9 | json | (?:the )?json licen[sc]e
json | 6 | 1.0 | good not evil | (?:the )?software shall be used for good not evil copyright
upl-1.0 | 5 | 0.9 | universal permissive | universal permissive license(?: upl)?(?: version)?(?: 1 0)?
osl-3.0 | 5 | 0.9 | open software license | open software license(?: version| v)?(?: 3 0)?
afl-3.0 | 5 | 0.9 | academic free | academic free license(?: version| v)?(?: 3 0)?
ecl-2.0 | 5 | 0.9 | educational community | educational community license(?: version| v)?(?: 2 0)?
apsl-2.0 | 5 | 0.9 | apple public source | apple public source license(?: version)?(?: 2 0)?
rpl-1.5 | 5 | 0.9 | reciprocal public | reciprocal public license(?: version)?(?: 1 5)?
qpl-1.0 | 5 | 0.9 | q public | (?:the )?q public license(?: version)?(?: 1 0)?
sleepycat | 5 | 0.9 | sleepycat | (?:the )?sleepycat licen[sc]e
bsl-1.1 | 5 | 0.9 | business source | business source license(?: version)?(?: 1 1)?
sspl-1.0 | 5 | 0.9 | server side public | server side public license(?: version| v)?(?: 1)?
elastic-2.0 | 5 | 0.9 | elastic license | elastic license(?: version)?(?: 2 0)?
commons-clause | 5 | 0.9 | commons clause | commons clause license condition(?: v 1 0| version 1 0)?
polyform | 5 | 0.9 | polyform | polyform (?:noncommercial|small business|shield|perimeter|strict) license(?: 1 0 0)?
mulan-2.0 | 5 | 0.9 | mulan | mulan (?:permissive software|psl) licen[sc]e(?: v2)?
odbl-1.0 | 5 | 0.9 | open database | open (?:data commons open )?database license(?: odbl)?(?: v1 0)?
odc-by-1.0 | 5 | 0.9 | open data commons | open data commons attribution license(?: v1 0)?
pddl-1.0 | 5 | 0.9 | open data commons | open data commons public domain dedication and licen[sc]e
cdla | 5 | 0.9 | community data | community data license agreement (?:permissive|sharing)(?: version)?(?: 1 0| 2 0)?
ogl-3.0 | 5 | 0.9 | open government | open government licen[sc]e(?: v3 0| version 3 0)?
llama-2 | 5 | 0.9 | llama | llama 2 community license(?: agreement)?
openrail | 5 | 0.9 | openrail | (?:bigscience |creativeml )?openrail(?: m)? licen[sc]e
proprietary | 4 | 0.8 | proprietary | proprietary (?:software )?licen[sc]e
commercial | 3 | 0.7 | commercial | commercial (?:software )?licen[sc]e
eula | 4 | 0.8 | end user | end user license agreement
proprietary | 1 | 0.5 | all rights reserved | all rights reserved
proprietary | 4 | 0.8 | confidential | confidential and proprietary (?:[^ ]+ ){0,8}(?:copyright|permission)
public-domain | 4 | 0.9 | public domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain | 1 | 0.5 | public domain | public domain
warranty | 1 | 0.3 | without warranty | (?:as is )?without warranty of any kind
warranty | 2 | 0.3 | merchantability | the implied warrant(?:y|ies) of merchantability(?: and)?(?: or)? fitness for a particular purpose
"""


def rule_rows() -> list[tuple[int, str, str, str, float, int]]:
    """(rule, label, pattern over whole words, keywords, confidence, priority), in order."""
    out = []
    for i, line in enumerate(RULES.strip().split("\n")):
        label, rank, sure, key, pattern = (x.strip() for x in line.split(" | ", 4))
        out.append((i, label, rf"(?<![^ ])(?:{pattern})(?![^ ])", key, float(sure), int(rank)))
    return out
