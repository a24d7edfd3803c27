"""Hand-written licence signatures, in order: ``priority | licence | keyword | regular expression``.

Every match contains the keyword, a literal, or one of several parted by ``;``; with none of them in the text the expression
isn't tried. A keyword may end within a word (``isc licen``). Expressions are matched
against lower-cased text; a blank stands for any white space. Priorities: 9 full grants and notices, 7 versioned
names, 5 plain names, 3 tags and links, 1 mere clues.
"""

_TEXT = r"""
9 | apache-2.0 | apache license | licensed under the apache license,? version 2(?:\.0)?(?: \(the "license"\))?(?:[;,] you may not use this file except in compliance with the license)?
9 | apache-2.0 | apache license | apache license,? version 2\.0,? january 2004
9 | apache-2.0 | apache software license | (?:distributed|released|available) under the apache software license,? (?:version )?2(?:\.0)?
9 | mit | mit license | (?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of the )?mit license
9 | mit | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
9 | mit-0 | mit no attribution | (?:licensed|released) under (?:the )?mit no attribution(?: license)?
9 | x11 | x consortium | except as contained in this notice, the name of the x consortium shall not be used
9 | isc | permission to use, copy, modify | permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted
9 | 0bsd | permission to use, copy, modify | permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided
9 | isc | isc licen | (?:licensed|released|distributed) under the (?:terms of the )?isc licen[sc]e
9 | bsd-2-clause | redistribution and use | redistribution and use in source and binary forms, with or without modification, are permitted provided that the following (?:two )?conditions are met
9 | bsd-3-clause | neither the name | neither the name of .{1,80}? nor the names of (?:its|any) contributors may be used to endorse or promote products
9 | bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
9 | bsd-new | bsd license | (?:licensed|released|distributed) under (?:the terms of )?(?:the|a) (?:new |modified |revised )bsd license
9 | bsd-2-clause | bsd license | (?:licensed|released|distributed) under (?:the terms of )?(?:the|a) (?:simplified|2-clause|two-clause) bsd license
9 | bsd-3-clause | bsd license | (?:licensed|released|distributed) under (?:the terms of )?(?:the|a) (?:3-clause|three-clause) bsd license
8 | bsd | bsd license | (?:licensed|released|distributed) under (?:the terms of )?(?:the|a) bsd license
8 | bsd | bsd-style license | (?:governed by|under|use of this source code is governed by) a bsd-style license(?: that can be found in the license file)?
9 | gpl-3.0-only | gnu general public license | (?:this work is )?licensed under the gnu general public license,? version 3(?:\.0)?(?: only)?
9 | gpl-2.0-only | gnu general public license | (?:this work is )?licensed under the gnu general public license,? version 2(?:\.0)?(?: only)?
9 | gpl-1.0-only | gnu general public license | (?:this work is )?licensed under the gnu general public license,? version 1(?:\.0)?(?: only)?
9 | gpl-3.0-or-later | gnu general public license | under the terms of the gnu general public license as published by the free software foundation[;,] either version 3 of the license,? or \(?at your option\)? any later version
9 | gpl-2.0-or-later | gnu general public license | under the terms of the gnu general public license as published by the free software foundation[;,] either version 2 of the license,? or \(?at your option\)? any later version
9 | gpl-3.0-only | gnu general public license | under the terms of the gnu general public license,? version 3,? as published by the free software foundation
9 | gpl-2.0-only | gnu general public license | under the terms of the gnu general public license,? version 2,? as published by the free software foundation
9 | gpl-1.0-or-later | gnu general public license | under the terms of the gnu general public license as published by the free software foundation[;,] either version 1,? or \(?at your option\)? any later version
9 | lgpl-3.0-or-later | lesser general public license | under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 3 of the license,? or \(?at your option\)? any later version
9 | lgpl-2.1-or-later | lesser general public license | under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 2\.1 of the license,? or \(?at your option\)? any later version
9 | lgpl-3.0-only | lesser general public license | licensed under the gnu lesser general public license,? version 3(?:\.0)?
9 | lgpl-2.1-only | lesser general public license | licensed under the gnu lesser general public license,? version 2\.1
9 | lgpl-2.0-or-later | library general public license | under the terms of the gnu library general public license as published by the free software foundation[;,] either version 2 of the license,? or \(?at your option\)? any later version
9 | agpl-3.0-or-later | affero general public license | under the terms of the gnu affero general public license as published by the free software foundation[;,] either version 3 of the license,? or \(?at your option\)? any later version
9 | agpl-3.0-only | affero general public license | licensed under the gnu affero general public license,? version 3(?:\.0)?
9 | gfdl-1.3-or-later | free documentation license | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license,? version 1\.3 or any later version
9 | gfdl-1.2-or-later | free documentation license | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license,? version 1\.2 or any later version
9 | gfdl-1.1-or-later | free documentation license | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license,? version 1\.1 or any later version
9 | cc-by-nc-nd-4.0 | cc by-nc-nd | licensed under (?:a )?cc by-nc-nd 4\.0
9 | cc-by-nc-sa-4.0 | cc by-nc-sa | licensed under (?:a )?cc by-nc-sa 4\.0
9 | cc-by-nc-4.0 | cc by-nc | licensed under (?:a )?cc by-nc 4\.0
9 | cc-by-nd-4.0 | cc by-nd | licensed under (?:a )?cc by-nd 4\.0
9 | cc-by-sa-4.0 | cc by-sa | licensed under (?:a )?cc by-sa 4\.0
9 | cc-by-4.0 | cc by 4.0 | licensed under (?:a )?cc by 4\.0
9 | cc-by-4.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution 4\.0(?: international)?(?: licen[sc]e)?
9 | cc-by-sa-4.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution[- ]share ?alike 4\.0(?: international)?(?: licen[sc]e)?
9 | cc-by-nc-4.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution[- ]non ?commercial 4\.0(?: international)?(?: licen[sc]e)?
9 | cc-by-nd-4.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution[- ]no ?deriv(?:ative)?s 4\.0(?: international)?(?: licen[sc]e)?
9 | cc-by-nc-sa-4.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution[- ]non ?commercial[- ]share ?alike 4\.0(?: international)?(?: licen[sc]e)?
9 | cc-by-nc-nd-4.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution[- ]non ?commercial[- ]no ?deriv(?:ative)?s 4\.0(?: international)?(?: licen[sc]e)?
9 | cc-by-3.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution 3\.0(?: unported)?(?: licen[sc]e)?
9 | cc-by-sa-3.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution[- ]share ?alike 3\.0(?: unported)?(?: licen[sc]e)?
9 | cc-by-nc-3.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution[- ]non ?commercial 3\.0(?: unported)?(?: licen[sc]e)?
9 | cc-by-nc-sa-3.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution[- ]non ?commercial[- ]share ?alike 3\.0(?: unported)?(?: licen[sc]e)?
9 | cc-by-2.5 | creative commons attribution | licensed under (?:a |the )?creative commons attribution 2\.5(?: licen[sc]e)?
9 | cc-by-2.0 | creative commons attribution | licensed under (?:a |the )?creative commons attribution 2\.0(?: licen[sc]e)?
9 | cc0-1.0 | public domain | waived all copyright and related or neighbou?ring rights .{0,80}?public domain
9 | cc0-1.0 | cc0 | (?:released|licensed|dedicated|available) (?:under|to the public domain under) (?:the )?(?:creative commons )?cc0(?: 1\.0)?(?: universal)?
9 | mpl-2.0 | mozilla public license | this source code form is subject to the terms of the mozilla public license,? v(?:ersion|\.)? ?2\.0
9 | mpl-1.1 | mozilla public license | the contents of this file are subject to the mozilla public license version 1\.1
9 | mpl-1.0 | mozilla public license | the contents of this file are subject to the mozilla public license version 1\.0
9 | npl-1.1 | netscape public license | the contents of this file are subject to the netscape public license version 1\.1
9 | epl-2.0 | eclipse public license | made available under the terms of the eclipse public license,? (?:v\.? ?|version )?2\.0
9 | epl-1.0 | eclipse public license | made available under the terms of the eclipse public license,? (?:v\.? ?|version )?1\.0
9 | cddl-1.0 | common development and distribution license | subject to the terms of the common development and distribution license(?:,? version 1\.0)?
9 | cddl-1.1 | common development and distribution license | subject to the terms of the common development and distribution license,? version 1\.1
9 | cpl-1.0 | common public license | made available under the terms of the common public license,? (?:v\.? ?|version )?1\.0
9 | ms-pl | microsoft public license | (?:licensed|released) under the microsoft public license
9 | ms-rl | microsoft reciprocal license | (?:licensed|released) under the microsoft reciprocal license
9 | artistic-2.0 | artistic license | under (?:the )?terms of the artistic license,? (?:version )?2\.0
9 | artistic-1.0 | artistic license | under (?:the )?terms of the artistic license,? (?:version )?1\.0
9 | perl-5 | as perl itself | (?:redistribute it and/or modify it )?under the same terms as perl itself
9 | psf-2.0 | python software foundation license | (?:licensed|distributed) under the python software foundation license(?: version 2)?
9 | ruby | as ruby | under the same terms as ruby(?: itself)?
9 | zlib | altered source versions | altered source versions must be plainly marked as such,? and must not be misrepresented as being the original software
9 | zlib | zlib licen;zlib/libpng licen | (?:licensed|released|distributed) under the zlib(?:/libpng)? licen[sc]e
9 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
9 | wtfpl | do what the | do what the f[u*]+ck? you want to(?: public license)?
9 | bsl-1.0 | boost software license | distributed under the boost software license,? version 1\.0
9 | ofl-1.1 | sil open font license | licensed under the sil open font license,? version 1\.1
9 | ofl-1.0 | sil open font license | licensed under the sil open font license,? version 1\.0
9 | openssl | openssl project | this product includes software developed by the openssl project for use in the openssl toolkit
9 | php-3.01 | php license | subject to version 3\.01? of the php license
9 | w3c | w3c | (?:licensed|distributed) under the w3c(?:\(r\)|®)? software (?:and document )?(?:notice and )?license
9 | eupl-1.2 | european union public licence | licensed under the european union public licence,? (?:v\.? ?|version )?1\.2
9 | eupl-1.1 | european union public licence | licensed under the european union public licence,? (?:v\.? ?|version )?1\.1
9 | osl-3.0 | open software license | licensed under the open software license,? version 3\.0
9 | afl-3.0 | academic free license | licensed under the academic free license,? version 3\.0
9 | afl-2.1 | academic free license | licensed under the academic free license,? version 2\.1
9 | ncsa | university of illinois | (?:licensed|distributed) under the university of illinois(?:/ncsa)? open source license
9 | postgresql | postgresql licen | (?:licensed|released) under the postgresql licen[sc]e
9 | vim | vim license | (?:licensed|released|distributed) under the vim license
9 | beerware | beer-ware | "?the beer-ware license"?(?: \(revision 42\))?
9 | odbl-1.0 | open database license | made available under the open database license
9 | odc-by-1.0 | open data commons attribution | made available under the open data commons attribution license
9 | pddl-1.0 | public domain dedication | made available under the public domain dedication and license v1\.0
9 | busl-1.1 | business source license | (?:licensed|available) under the business source license,? (?:version )?1\.1
9 | sspl-1.0 | server side public license | (?:licensed|available) under the server side public license(?:,? (?:version |v)1)?
9 | elastic-2.0 | elastic license | (?:licensed|available) under the elastic license,? (?:version )?2\.0
9 | commons-clause | commons clause;provided to you by the licensor | the software is provided to you by the licensor under the license.{0,40}? subject to the following condition|"?commons clause"? license condition(?: v1\.0)?
9 | polyform-noncommercial-1.0.0 | polyform | polyform noncommercial license 1\.0\.0
9 | polyform-shield-1.0.0 | polyform | polyform shield license 1\.0\.0
9 | json | shall be used for good | the software shall be used for good, not evil
9 | proprietary | unauthorized copying | unauthorized copying of this (?:file|document|work|software),? via any medium,? is strictly prohibited
9 | proprietary | be reproduced | (?:no part of this \w+|this (?:document|publication|work)) may (?:not )?be reproduced.{0,60}? without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)
9 | public-domain | public domain | (?:this (?:work|file|text) is |has been )?(?:released|placed|dedicated) (?:in|into|to) the public domain
9 | crown-copyright | open government licence | contains public sector information licensed under the open government licence(?: v3\.0)?
9 | ogl-uk-3.0 | open government licence | licensed under the open government licence v(?:ersion )?3\.0
9 | ogl-uk-2.0 | open government licence | licensed under the open government licence v(?:ersion )?2\.0
9 | openrail-m | openrail;open rail | licensed under (?:the )?(?:creativeml |bigscience )?open ?rail(?:-m)?(?: license)?
9 | etalab-2.0 | licence ouverte | (?:sous )?licence ouverte(?: / open licence)?(?: version 2\.0)?
9 | cc-by-4.0 | creative commons | sous licence creative commons attribution 4\.0
9 | cc-by-sa-4.0 | creative commons | sous licence creative commons attribution - partage dans les mêmes conditions 4\.0
9 | cc-by-4.0 | creative commons | lizenziert unter (?:einer )?creative commons namensnennung 4\.0
9 | cc-by-sa-4.0 | creative commons | lizenziert unter (?:einer )?creative commons namensnennung - weitergabe unter gleichen bedingungen 4\.0
9 | cc-by-4.0 | creative commons | bajo (?:una )?licencia creative commons (?:reconocimiento|atribución) 4\.0
7 | apache-2.0 | apache license | apache license,? (?:version |v\.? ?)?2(?:\.0)?\b
7 | apache-1.1 | apache software license | apache software license,? (?:version )?1\.1
7 | apache-1.0 | apache software license | apache software license,? (?:version )?1\.0
7 | gpl-3.0-or-later | general public license | gnu general public license,? (?:version |v)3(?:\.0)? or (?:any )?later
7 | gpl-2.0-or-later | general public license | gnu general public license,? (?:version |v)2(?:\.0)? or (?:any )?later
7 | gpl-3.0 | general public license | gnu general public license,? (?:version |v)3(?:\.0)?\b
7 | gpl-2.0 | general public license | gnu general public license,? (?:version |v)2(?:\.0)?\b
7 | lgpl-3.0 | lesser general public license | gnu lesser general public license,? (?:version |v)3(?:\.0)?\b
7 | lgpl-2.1 | lesser general public license | gnu lesser general public license,? (?:version |v)2\.1\b
7 | lgpl-2.0 | library general public license | gnu library general public license,? (?:version |v)2(?:\.0)?\b
7 | agpl-3.0 | affero general public license | gnu affero general public license,? (?:version |v)3(?:\.0)?\b
7 | gfdl-1.3 | free documentation license | gnu free documentation license,? (?:version |v)1\.3
7 | gfdl-1.2 | free documentation license | gnu free documentation license,? (?:version |v)1\.2
7 | mpl-2.0 | mozilla public license | mozilla public license,? (?:version |v\.? ?)?2\.0
7 | mpl-1.1 | mozilla public license | mozilla public license,? (?:version |v\.? ?)?1\.1
7 | epl-2.0 | eclipse public license | eclipse public license,? (?:version |v\.? ?|- v ?)?2\.0
7 | epl-1.0 | eclipse public license | eclipse public license,? (?:version |v\.? ?|- v ?)?1\.0
7 | bsl-1.0 | boost software license | boost software license(?:,? version |,? v| - version )1\.0
7 | ofl-1.1 | open font license | sil open font license,? (?:version |v)?1\.1
7 | eupl-1.2 | eupl | eupl[- ]?v?\.? ?1\.2
7 | eupl-1.1 | eupl | eupl[- ]?v?\.? ?1\.1
7 | artistic-2.0 | artistic license | artistic license,? (?:version |v)?2\.0
7 | osl-3.0 | open software license | open software license,? (?:version |v\.? ?)?3\.0
7 | afl-3.0 | academic free license | academic free license,? (?:version |v\.? ?)?3\.0
7 | cc-by-4.0 | cc by 4.0 | \bcc by 4\.0\b
7 | cc-by-4.0 | cc-by-4.0 | \bcc-by-4\.0\b
7 | cc-by-3.0 | cc by 3.0 | \bcc by 3\.0\b
7 | cc-by-3.0 | cc-by-3.0 | \bcc-by-3\.0\b
7 | cc-by-sa-4.0 | cc by-sa 4.0 | \bcc by-sa 4\.0\b
7 | cc-by-sa-4.0 | cc-by-sa-4.0 | \bcc-by-sa-4\.0\b
7 | cc-by-sa-3.0 | cc by-sa 3.0 | \bcc by-sa 3\.0\b
7 | cc-by-sa-3.0 | cc-by-sa-3.0 | \bcc-by-sa-3\.0\b
7 | cc-by-nc-4.0 | cc by-nc 4.0 | \bcc by-nc 4\.0\b
7 | cc-by-nc-4.0 | cc-by-nc-4.0 | \bcc-by-nc-4\.0\b
7 | cc-by-nc-sa-4.0 | cc by-nc-sa 4.0 | \bcc by-nc-sa 4\.0\b
7 | cc-by-nc-sa-4.0 | cc-by-nc-sa-4.0 | \bcc-by-nc-sa-4\.0\b
7 | cc-by-nc-nd-4.0 | cc by-nc-nd 4.0 | \bcc by-nc-nd 4\.0\b
7 | cc-by-nc-nd-4.0 | cc-by-nc-nd-4.0 | \bcc-by-nc-nd-4\.0\b
7 | cc-by-nd-4.0 | cc by-nd 4.0 | \bcc by-nd 4\.0\b
7 | cc-by-nd-4.0 | cc-by-nd-4.0 | \bcc-by-nd-4\.0\b
7 | cc0-1.0 | cc0 1.0 | \bcc0 1\.0(?: universal)?\b
7 | bsd-3-clause | bsd | \b(?:3-clause bsd|bsd[- ]3[- ]clause)\b
7 | bsd-2-clause | bsd | \b(?:2-clause bsd|bsd[- ]2[- ]clause)\b
7 | bsd-0-clause | bsd | \b(?:0-clause bsd|zero-clause bsd)\b
7 | cecill-2.1 | cecill | \bcecill(?: license| free software license agreement)?,? (?:version |v)?2\.1
7 | cecill-b | cecill-b | \bcecill-b\b
7 | cecill-c | cecill-c | \bcecill-c\b
7 | mulanpsl-2.0 | mulan permissive | mulan permissive software license,? (?:version 2|v2)
7 | upl-1.0 | universal permissive license | universal permissive license,? (?:version |v\.? ?)1\.0
7 | ecl-2.0 | educational community license | educational community license,? (?:version )?2\.0
7 | zpl-2.1 | zope public license | zope public license,? (?:\(zpl\) )?version 2\.1
7 | lppl-1.3c | latex project public license | latex project public license,? (?:either )?(?:version |v)1\.3c?
7 | qpl-1.0 | q public license | \bq public license(?:,? version 1\.0)?
7 | sleepycat | sleepycat | sleepycat(?: software)? (?:public )?license
7 | apsl-2.0 | apple public source license | apple public source license,? (?:version |v)2(?:\.0)?
7 | ipl-1.0 | ibm public license | ibm public license,? (?:version |v)?1\.0
7 | nposl-3.0 | non-profit open software license | non-profit open software license,? (?:version )?3\.0
7 | rpl-1.5 | reciprocal public license | reciprocal public license,? (?:version )?1\.5
7 | sissl | sun industry standards source license | sun industry standards source license(?:,? version 1\.1)?
7 | cpal-1.0 | common public attribution license | common public attribution license,? (?:version )?1\.0
7 | llama-2 | llama 2 community license | llama 2 community license(?: agreement)?
7 | llama-3 | llama 3 community license | (?:meta )?llama 3 community license(?: agreement)?
5 | apache | apache license | \bapache license\b
5 | mit | mit license | \bmit license\b
5 | mit | mit-style | \bmit-style licen[sc]e\b
5 | mit | expat licen | \bexpat licen[sc]e\b
5 | isc | isc licen | \bisc licen[sc]e\b
5 | bsd | bsd licen | \bbsd licen[sc]e\b
5 | gpl | general public license | \bgnu general public license\b
5 | lgpl | lesser general public license | \bgnu lesser general public license\b
5 | lgpl | library general public license | \bgnu library general public license\b
5 | agpl | affero general public license | \b(?:gnu )?affero general public license\b
5 | gfdl | free documentation license | \bgnu free documentation license\b
5 | mpl | mozilla public license | \bmozilla public license\b
5 | epl | eclipse public license | \beclipse public license\b
5 | cddl | common development and distribution license | \bcommon development and distribution license\b
5 | cc | creative commons | \bcreative commons(?: [a-z-]+){0,4} licen[sc]e\b
5 | cc0 | cc0 | \bcc0\b
5 | unlicense | the unlicense | \bthe unlicense\b
5 | ofl | open font license | \b(?:sil )?open font license\b
5 | boost | boost software license | \bboost software license\b
5 | zlib | zlib licen | \bzlib licen[sc]e\b
5 | artistic | artistic license | \bartistic license\b
5 | wtfpl | wtfpl | \bwtfpl\b
5 | ogl | open government licence | \bopen government licence\b
5 | odbl | odbl | \bodbl\b
5 | proprietary | proprietary licen | \bproprietary licen[sc]e\b
5 | proprietary | proprietary and confidential | \bproprietary and confidential\b
5 | commercial | commercial licen | \bcommercial licen[sc]e\b
5 | eula | user licen | \bend[- ]user licen[sc]e agreement\b
3 | spdx-tag | spdx-license-identifier | spdx-license-identifier: ?\(?[a-z0-9.+-]+(?: (?:and|or|with) [a-z0-9.+-]+)*\)?
3 | apache-2.0 | apache.org/licenses | (?:https?://)?(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
3 | mit | opensource.org/licenses/mit | (?:https?://)?(?:www\.)?opensource\.org/licenses/mit(?:-license\.php)?
3 | bsd-3-clause | opensource.org/licenses/bsd-3-clause | (?:https?://)?(?:www\.)?opensource\.org/licenses/bsd-3-clause
3 | bsd-2-clause | opensource.org/licenses/bsd-2-clause | (?:https?://)?(?:www\.)?opensource\.org/licenses/bsd-2-clause
3 | gpl | gnu.org/licenses/gpl | (?:https?://)?(?:www\.)?gnu\.org/licenses/gpl(?:-[123]\.0)?(?:\.html|\.txt)?
3 | lgpl | gnu.org/licenses/lgpl | (?:https?://)?(?:www\.)?gnu\.org/licenses/lgpl(?:-[23]\.[01])?(?:\.html|\.txt)?
3 | agpl | gnu.org/licenses/agpl | (?:https?://)?(?:www\.)?gnu\.org/licenses/agpl(?:-3\.0)?(?:\.html|\.txt)?
3 | gnu | gnu.org/licenses | (?:https?://)?(?:www\.)?gnu\.org/licenses/?
3 | mpl-2.0 | mozilla.org/mpl/2.0 | (?:https?://)?(?:www\.)?mozilla\.org/mpl/2\.0/?
3 | cc-by | creativecommons.org/licenses/by/ | (?:https?://)?(?:www\.)?creativecommons\.org/licenses/by/[0-9.]+/?
3 | cc-by-sa | creativecommons.org/licenses/by-sa/ | (?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-sa/[0-9.]+/?
3 | cc-by-nc | creativecommons.org/licenses/by-nc/ | (?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nc/[0-9.]+/?
3 | cc-by-nd | creativecommons.org/licenses/by-nd/ | (?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nd/[0-9.]+/?
3 | cc-by-nc-sa | creativecommons.org/licenses/by-nc-sa/ | (?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nc-sa/[0-9.]+/?
3 | cc-by-nc-nd | creativecommons.org/licenses/by-nc-nd/ | (?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nc-nd/[0-9.]+/?
3 | cc0-1.0 | creativecommons.org/publicdomain/zero | (?:https?://)?(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0/?
3 | epl | eclipse.org/legal/epl | (?:https?://)?(?:www\.)?eclipse\.org/legal/epl-(?:v10|2\.0)(?:\.html)?
3 | bsl-1.0 | boost.org/license_1_0 | (?:https?://)?(?:www\.)?boost\.org/license_1_0\.txt
3 | unlicense | unlicense.org | (?:https?://)?(?:www\.)?unlicense\.org/?
3 | wtfpl | wtfpl.net | (?:https?://)?(?:www\.)?wtfpl\.net(?:/about)?/?
1 | all-rights-reserved | all rights reserved | \ball rights reserved\b
1 | all-rights-reserved | tous droits réservés | \btous droits réservés\b
1 | all-rights-reserved | alle rechte vorbehalten | \balle rechte vorbehalten\b
1 | all-rights-reserved | todos los derechos reservados | \btodos los derechos reservados\b
1 | copyright | copyright | \bcopyright (?:\(c\)|©)? ?(?:19|20)\d\d(?:[-–, ]+(?:19|20)\d\d)*
1 | copyright | © | © ?(?:19|20)\d\d(?:[-–, ]+(?:19|20)\d\d)*
1 | license-clue | licensed under | \blicensed under (?:the|a|an) [^.\n]{3,80}
1 | license-clue | license file | \bsee (?:the )?(?:accompanying )?license file\b
1 | license-clue | licence:;license: | ^ ?licen[cs]e: ?[^\n]{2,60}
1 | license-clue | licence:;license: | ^ ?licen[cs]e: ?[^\n]{2,60}
"""

#: (number, priority, licence, keyword, expression)
RULES = [(n, int(p), name, word, rule) for n, (p, name, word, rule) in enumerate([y.strip() for y in x.split(" | ", 3)] for x in _TEXT.strip().splitlines())]
