"""Hand-written signatures of licenses: bodies, standard notices, exceptions,
addresses and short names. A line is score | label | regular expression over a
text's words, lower-cased and joined by single spaces. Alternatives and options
stand in groups; the words outside groups must all occur in a text before its
rule is tried."""

from __future__ import annotations

import re

#: Signatures of license texts, most specific forms of a license first (fixed values).
SIGNATURES = r"""
0.98 | mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
0.95 | mit | permission is hereby granted free of charge to any person obtaining a copy
0.95 | mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
0.9 | mit | this (?:software|project|code|package|library|work|repository) is (?:licensed|released|distributed|available|published) under the (?:terms of the )?mit licen[cs]e
0.9 | mit | (?:use of this source code is governed by|see the) an? mit style licen[cs]e
0.85 | mit | dual licensed under (?:the )?mit (?:licen[cs]e )?(?:and|or)
0.85 | mit | opensource org licenses mit(?: license(?: php)?)?
0.98 | mit-0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
0.9 | mit-0 | mit no attribution(?: licen[cs]e)?
0.9 | x11 | except as contained in this notice the name of the x consortium shall not be used in advertising
0.9 | mit-advertising | except as contained in this notice the name of [^ ]+ (?:[^ ]+ ){0,4}?shall not be used in advertising or otherwise to promote the sale use or other dealings
0.98 | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0.95 | isc | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
0.97 | 0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
0.9 | 0bsd | (?:bsd zero clause|zero clause bsd|free public license 1 0 0)(?: licen[cs]e)?
0.9 | hpnd | permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted(?: without fee)? provided that the above copyright notice appears? in all copies
0.95 | bsd | redistribution and use in source and binary forms with or without modification are permitted
0.98 | bsd-3 | neither the names? of (?:[^ ]+ ){1,12}?nor the names of (?:its|any|the|their) (?:[^ ]+ )?contributors may be used to endorse or promote products derived from this software
0.97 | bsd-4 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
0.9 | bsd-2 | (?:simplified bsd|freebsd|two clause bsd|2 clause bsd) licen[cs]e
0.9 | bsd-3 | (?:new bsd|modified bsd|revised bsd|three clause bsd|3 clause bsd) licen[cs]e
0.9 | bsd-4 | (?:original bsd|four clause bsd|4 clause bsd|bsd old) licen[cs]e
0.85 | bsd | (?:use of this source code is governed by|licensed under) an? bsd style licen[cs]e
0.9 | bsd-patent | grant of patent rights each copyright holder and contributor hereby grants to those receiving rights under this license
0.85 | bsd-3 | opensource org licenses bsd 3 clause
0.85 | bsd-2 | opensource org licenses bsd 2 clause
0.98 | apache-2 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
0.97 | apache-2 | apache license version 2 0 january 2004
0.95 | apache-2 | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license
0.9 | apache-2 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
0.9 | apache-2 | (?:www )?apache org licenses license 2 0(?: txt| html)?
0.95 | apache-1.1 | the apache software license version 1 1
0.95 | apache-1.1 | the end user documentation included with the redistribution if any must include the following acknowledg(?:e)?ment this product includes software developed by the apache software foundation
0.9 | apache-1.0 | this product includes software developed by the apache group for use in the apache http server project
0.98 | gpl-3-or-later | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
0.98 | gpl-2-or-later | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
0.98 | gpl-1-or-later | under the terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version
0.97 | gpl-3-only | under the terms of the gnu general public license (?:as published by the free software foundation )?version 3(?: of the license)? only
0.97 | gpl-2-only | under the terms of the gnu general public license (?:as published by the free software foundation )?version 2(?: of the license)? only
0.96 | gpl-2-only | under the terms of version 2 of the gnu general public license as published by the free software foundation
0.96 | gpl-3-only | under the terms of version 3 of the gnu general public license as published by the free software foundation
0.96 | gpl-2-only | under the terms of the gnu general public license version 2 as published by the free software foundation
0.96 | gpl-3-only | under the terms of the gnu general public license version 3 as published by the free software foundation
0.95 | gpl-3 | gnu general public license version 3 29 june 2007
0.95 | gpl-2 | gnu general public license version 2 june 1991
0.95 | gpl-1 | gnu general public license version 1 february 1989
0.9 | gpl | the gnu general public license is a free copyleft license for software and other kinds of works
0.9 | gpl-2 | the licenses for most software are designed to take away your freedom to share and change it
0.9 | gpl-3 | the licenses for most software and other practical works are designed to take away your freedom to share and change the works
0.9 | gpl-2 | activities other than copying distribution and modification are not covered by this license they are outside its scope
0.9 | gpl-3 | you may convey verbatim copies of the program s source code as you receive it in any medium
0.85 | gpl | you should have received a copy of the gnu general public license along with
0.85 | gpl-3 | (?:www )?gnu org licenses gpl 3 0(?: html| txt| en html)?
0.85 | gpl-2 | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
0.8 | gpl | (?:www )?gnu org (?:licenses|copyleft) gpl(?: html| txt| en html)?
0.8 | gpl-2 | (?:gplv2|gpl v2)
0.8 | gpl-3 | (?:gplv3|gpl v3)
0.85 | gpl-2-or-later | (?:gplv2|gpl v2|gpl 2|gpl version 2) or (?:any )?(?:later|newer|above|higher)
0.85 | gpl-3-or-later | (?:gplv3|gpl v3|gpl 3|gpl version 3) or (?:any )?(?:later|newer|above|higher)
0.98 | lgpl-3-or-later | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
0.98 | lgpl-2.1-or-later | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
0.98 | lgpl-2-or-later | under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
0.96 | lgpl-2.1-only | under the terms of the gnu lesser general public license version 2 1 (?:only|as published by the free software foundation)
0.96 | lgpl-3-only | under the terms of the gnu lesser general public license version 3 (?:only|as published by the free software foundation)
0.95 | lgpl-2 | gnu library general public license version 2 june 1991
0.95 | lgpl-2.1 | gnu lesser general public license version 2 1 february 1999
0.95 | lgpl-3 | gnu lesser general public license version 3 29 june 2007
0.9 | lgpl-3 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
0.9 | lgpl | this license the lesser general public license applies to some specially designated software packages typically libraries
0.85 | lgpl | you should have received a copy of the gnu (?:lesser|library) general public license along with
0.85 | lgpl-3 | (?:www )?gnu org licenses lgpl 3 0(?: html| txt| en html)?
0.85 | lgpl-2.1 | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt| en html)?
0.8 | lgpl-3 | (?:lgplv3|lgpl v3)
0.8 | lgpl-2.1 | (?:lgplv2 1|lgpl v2 1)
0.98 | agpl-3-or-later | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
0.97 | agpl-3-only | under the terms of the gnu affero general public license version 3 (?:only|as published by the free software foundation)
0.95 | agpl-3 | gnu affero general public license version 3 19 november 2007
0.9 | agpl-3 | the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software
0.95 | agpl-1 | affero general public license version 1 march 2002
0.85 | agpl | you should have received a copy of the gnu affero general public license along with
0.85 | agpl-3 | (?:www )?gnu org licenses agpl 3 0(?: html| txt| en html)?
0.8 | agpl-3 | (?:agplv3|agpl v3)
0.95 | classpath-exception | as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable
0.9 | classpath-exception | (?:with|gpl) classpath exception(?: 2 0)?
0.95 | gcc-exception | (?:gcc runtime library exception|you have permission to propagate a work of target code formed by combining the runtime library with independent modules)
0.95 | autoconf-exception | as a special exception the free software foundation gives unlimited permission to copy distribute and modify (?:it|the configure script)
0.95 | autoconf-exception | as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf
0.95 | bison-exception | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
0.9 | openssl-exception | (?:gives|give) permission to link the code of (?:[^ ]+ ){1,8}?with (?:the )?openssl
0.9 | font-exception | if you create a document which uses this font and embed this font or unaltered portions of this font into the document
0.9 | linking-exception | (?:static linking|linking this library statically or dynamically with other modules is making a combined work)
0.98 | gfdl-1.3-or-later | under the terms of the gnu free documentation license version 1 3 or any later version
0.98 | gfdl-1.2-or-later | under the terms of the gnu free documentation license version 1 2 or any later version
0.98 | gfdl-1.1-or-later | under the terms of the gnu free documentation license version 1 1 or any later version
0.9 | gfdl | the purpose of this license is to make a manual textbook or other functional and useful document free
0.85 | gfdl | gnu free documentation license
0.97 | mpl-2 | this source code form is subject to the terms of the mozilla public license v 2 0
0.95 | mpl-2 | mozilla public license version 2 0 1 definitions
0.97 | mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1 the license
0.97 | mpl-1 | the contents of this file are subject to the mozilla public license version 1 0 the license
0.9 | mpl-2 | if a copy of the mpl was not distributed with this file you can obtain one at
0.85 | mpl-2 | (?:www )?mozilla org (?:en us )?mpl 2 0
0.85 | mpl-1.1 | (?:www )?mozilla org mpl mpl 1 1(?: html| txt)?
0.9 | npl-1.1 | the contents of this file are subject to the netscape public license version 1 1
0.97 | epl-2 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
0.97 | epl-1 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
0.95 | epl-2 | the accompanying program is provided under the terms of this eclipse public license agreement
0.95 | edl-1 | eclipse distribution license v 1 0
0.95 | cpl-1 | the accompanying program is provided under the terms of this common public license agreement
0.9 | cpl-1 | common public license (?:version |v )?1 0
0.9 | ipl-1 | ibm public license version 1 0
0.97 | cddl-1 | the contents of this file are subject to the terms of the common development and distribution license
0.95 | cddl-1 | common development and distribution license cddl version 1 0
0.95 | cddl-1.1 | common development and distribution license cddl version 1 1
0.95 | bsl-1 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
0.95 | bsl-1 | distributed under the boost software license version 1 0
0.9 | bsl-1 | (?:www )?boost org license 1 0 txt
0.97 | zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
0.95 | zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software
0.9 | libpng | this copy of the libpng notices is provided for your convenience
0.9 | libpng | the png reference library is supplied as is
0.97 | unlicense | this is free and unencumbered software released into the public domain
0.9 | unlicense | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
0.85 | unlicense | (?:for more information please refer to )?unlicense org
0.97 | wtfpl | do what the fuck you want to public license
0.9 | wtfpl | you just do what the fuck you want to
0.95 | beerware | if we meet some day and you think this stuff is worth it you can buy me a beer
0.9 | beerware | the beer ware license revision 42
0.95 | artistic-2 | the artistic license 2 0 copyright c 2000 2006 the perl foundation
0.9 | artistic-1 | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
0.95 | perl | (?:you can|you may) redistribute it and or modify it under the same terms as perl itself
0.9 | perl | (?:under|on) the same terms as (?:perl|the perl 5 programming language system) itself
0.95 | python-2 | psf license agreement for python
0.95 | python-2 | python software foundation license(?: agreement)?(?: version 2)?
0.9 | cnri-python | cnri open source license agreement
0.9 | ruby | you may (?:make and give away verbatim copies of the source form of the software without restriction|redistribute it and or modify it under (?:either )?the terms of (?:the )?ruby(?: s)? license)
0.95 | php-3.01 | this source file is subject to version 3 01 of the php license
0.95 | php-3 | this source file is subject to version 3 0 of the php license
0.9 | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
0.9 | ssleay | this product includes cryptographic software written by eric young
0.95 | ncsa | university of illinois ncsa open source license
0.95 | icu | icu license icu 1 8 1 and later
0.95 | unicode | unicode inc license agreement data files and software
0.9 | unicode-3 | unicode license v3
0.95 | w3c | w3c software (?:notice and license|and document notice and license)
0.9 | w3c | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms
0.95 | sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code for the (?:db )?software
0.95 | qpl-1 | the q public license version 1 0
0.95 | ms-pl | microsoft public license ms pl
0.95 | ms-rl | microsoft reciprocal license ms rl
0.95 | osl-3 | licensed under the open software license version 3 0
0.9 | osl-3 | open software license (?:v |version )?3 0
0.95 | afl-3 | licensed under the academic free license version 3 0
0.9 | afl-2.1 | licensed under the academic free license version 2 1
0.95 | ecl-2 | licensed under the educational community license version 2 0
0.95 | efl-2 | eiffel forum license(?: version)? 2
0.95 | postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
0.95 | vim | there are no restrictions on distributing unmodified copies of vim
0.95 | curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided
0.95 | json | the software shall be used for good not evil
0.95 | info-zip | this is version [^ ]+ [^ ]+ [^ ]+ of the info zip (?:copyright and )?license
0.95 | bzip2 | this program bzip2 the associated library libbzip2 and all documentation are copyright
0.95 | ijg | this software is based in part on the work of the independent jpeg group
0.95 | ftl | portions of this software are copyright [^ ]+ (?:[^ ]+ )?the freetype project
0.9 | ftl | the freetype project license
0.95 | tcl | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose provided that existing copyright notices are retained
0.95 | ntp | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies
0.95 | zpl-2.1 | zope public license zpl version 2 1
0.95 | zpl-2 | zope public license zpl version 2 0
0.95 | lppl-1.3c | under the conditions of the latex project public license either version 1 3c? of this license or at your option any later version
0.9 | lppl | latex project public license
0.95 | cecill-2.1 | cecill free software license agreement version 2 1
0.95 | cecill-2 | cecill free software license agreement version 2 0
0.9 | cecill-b | cecill b free software license agreement
0.9 | cecill-c | cecill c free software license agreement
0.95 | mulan-2 | licensed under mulan psl v2
0.9 | mulan-1 | licensed under (?:the )?mulan psl v1
0.95 | eupl-1.2 | licensed under the eupl(?: version)? (?:v )?1 2 or as soon they will be approved by the european commission subsequent versions
0.95 | eupl-1.1 | licensed under the eupl(?: version)? (?:v )?1 1 or as soon they will be approved by the european commission subsequent versions
0.9 | cpal-1 | common public attribution license(?: version)? 1 0
0.9 | rpl-1.5 | reciprocal public license(?: version)? 1 5
0.9 | sissl | sun industry standards source license
0.9 | aladdin | aladdin free public license
0.9 | nasa-1.3 | nasa open source agreement(?: version)? 1 3
0.9 | upl-1 | universal permissive license (?:v |version )?1 0
0.9 | blueoak-1 | blue oak model license(?: version)? 1 0 0
0.9 | fair | usage of the works is permitted provided that this instrument is retained with the works
0.97 | ofl-1.1 | this font software is licensed under the sil open font license version 1 1
0.95 | ofl-1.1 | permission is hereby granted free of charge to any person obtaining a copy of the font software
0.85 | ofl | (?:scripts sil org ofl|openfontlicense org)
0.9 | ubuntu-font-1 | ubuntu font licence version 1 0
0.97 | cc0 | to the extent possible under law (?:[^ ]+ ){1,8}?has waived all copyright and related or neighboring rights to
0.97 | cc0-1 | creative commons legal code cc0 1 0 universal
0.95 | cc0-1 | creativecommons org publicdomain zero 1 0
0.9 | public-domain | creativecommons org publicdomain mark 1 0
0.95 | cc-by-4 | creativecommons org licenses by 4 0
0.95 | cc-by-3 | creativecommons org licenses by 3 0
0.95 | cc-by-2.5 | creativecommons org licenses by 2 5
0.95 | cc-by-2 | creativecommons org licenses by 2 0
0.95 | cc-by-sa-4 | creativecommons org licenses by sa 4 0
0.95 | cc-by-sa-3 | creativecommons org licenses by sa 3 0
0.95 | cc-by-sa-2.5 | creativecommons org licenses by sa 2 5
0.95 | cc-by-sa-2 | creativecommons org licenses by sa 2 0
0.95 | cc-by-nc-4 | creativecommons org licenses by nc 4 0
0.95 | cc-by-nc-3 | creativecommons org licenses by nc 3 0
0.95 | cc-by-nc-sa-4 | creativecommons org licenses by nc sa 4 0
0.95 | cc-by-nc-sa-3 | creativecommons org licenses by nc sa 3 0
0.95 | cc-by-nc-nd-4 | creativecommons org licenses by nc nd 4 0
0.95 | cc-by-nc-nd-3 | creativecommons org licenses by nc nd 3 0
0.95 | cc-by-nd-4 | creativecommons org licenses by nd 4 0
0.95 | cc-by-nd-3 | creativecommons org licenses by nd 3 0
0.97 | cc-by-4 | this work is licensed under (?:a |the )?creative commons attribution 4 0 international licen[cs]e
0.97 | cc-by-3 | this work is licensed under (?:a |the )?creative commons attribution 3 0 (?:unported|[^ ]+) licen[cs]e
0.97 | cc-by-sa-4 | this work is licensed under (?:a |the )?creative commons attribution share ?alike 4 0 international licen[cs]e
0.97 | cc-by-sa-3 | this work is licensed under (?:a |the )?creative commons attribution share ?alike 3 0 (?:unported|[^ ]+) licen[cs]e
0.97 | cc-by-nc-4 | this work is licensed under (?:a |the )?creative commons attribution non ?commercial 4 0 international licen[cs]e
0.97 | cc-by-nc-sa-4 | this work is licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike 4 0 international licen[cs]e
0.97 | cc-by-nc-nd-4 | this work is licensed under (?:a |the )?creative commons attribution non ?commercial no ?derivatives 4 0 international licen[cs]e
0.97 | cc-by-nd-4 | this work is licensed under (?:a |the )?creative commons attribution no ?derivatives 4 0 international licen[cs]e
0.95 | cc-by-4 | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license
0.95 | cc-by-sa-4 | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license
0.95 | cc-by-nc-4 | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license
0.95 | cc-by-nc-sa-4 | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial sharealike 4 0 international public license
0.95 | cc-by-nc-nd-4 | by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial noderivatives 4 0 international public license
0.9 | cc-by | you are free to share copy and redistribute the material in any medium or format
0.9 | cc-by-nc | you may not use the material for commercial purposes
0.9 | cc-by-nd | if you remix transform or build upon the material you may not distribute the modified material
0.9 | cc-by-sa | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
0.95 | odbl-1 | this (?:[^ ]+ ){1,6}?is made available under the open database license
0.9 | odbl-1 | (?:opendatacommons org licenses odbl(?: 1 0)?|open database license odbl(?: v1 0)?)
0.9 | odc-by-1 | (?:opendatacommons org licenses by(?: 1 0)?|open data commons attribution license)
0.9 | pddl-1 | (?:opendatacommons org licenses pddl(?: 1 0)?|open data commons public domain dedication and licen[cs]e)
0.95 | ogl-uk-3 | contains public sector information licensed under the open government licence v3 0
0.9 | ogl-uk | open government licence (?:v |version )?[123](?: 0)?
0.9 | cdla-permissive | community data license agreement permissive(?: version)? [12] 0
0.9 | cdla-sharing | community data license agreement sharing(?: version)? 1 0
0.95 | openrail-m | (?:bigscience|creativeml) open ?rail(?: m)?(?: license)?
0.9 | llama-community | llama [234](?: [0-9])? community license(?: agreement)?
0.95 | busl-1.1 | business source license 1 1
0.9 | busl-1.1 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
0.95 | sspl-1 | server side public license(?: version)? 1
0.95 | elastic-2 | you may not provide the software to third parties as a hosted or managed service
0.9 | elastic-2 | elastic license 2 0
0.95 | commons-clause | commons clause license condition v1 0
0.9 | polyform-noncommercial | polyform noncommercial license 1 0 0
0.9 | polyform-small-business | polyform small business license 1 0 0
0.9 | hippocratic | hippocratic license(?: version)? [123] [0-9]
0.85 | public-domain | (?:released into|placed in|placed into|dedicated to|donated to) the public domain
0.85 | public-domain | this (?:work|file|software|code|image|text) is (?:hereby )?(?:in|part of) the public domain
0.85 | public-domain | the author(?:s)? (?:hereby )?disclaims? copyright to this source code
0.85 | us-government | (?:as a work of the united states government|this is a work of the u ?s ?(?:federal )?government)(?: it| and)? is (?:not subject to copyright protection|in the public domain)
0.9 | proprietary | (?:this|the) (?:software|document|material|file|information) (?:is|contains) (?:the )?(?:confidential|proprietary)(?: and (?:confidential|proprietary))?(?: information| property)? of
0.9 | proprietary | no part of this (?:publication|book|document|work|software|site) may be reproduced
0.9 | proprietary | unauthorized (?:copying|reproduction|use|distribution) of (?:this|any part of) (?:[^ ]+ ){0,6}?is (?:strictly )?prohibited
0.85 | proprietary | (?:for|limited to) (?:your )?personal (?:and )?non ?commercial use only
0.85 | proprietary | may not be (?:copied|reproduced|published|broadcast|rewritten)(?: or)? (?:[^ ]+ ){0,3}?(?:redistributed|transmitted|retransmitted)(?: [^ ]+){0,3} without (?:[^ ]+ ){0,3}?permission
0.8 | proprietary | by (?:installing|using|downloading) (?:this|the) (?:software|product) you (?:accept|agree to)(?: be bound by)? (?:the terms of )?this (?:end user )?licen[cs]e agreement
0.8 | proprietary | end user licen[cs]e agreement
0.8 | proprietary | trade secrets? of [^ ]+
0.5 | proprietary | all rights reserved
"""


def signatures() -> list[tuple[float, str, str]]:
    """(score, label, pattern) of every line."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        score, label, pattern = line.split(" | ", 2)
        out.append((float(score), label, pattern))
    return out


_GROUP = re.compile(r"\(\?:([^()]*)\)(?:\?|\{\d+,\d*\}\??)?")


def keywords(pattern: str) -> tuple[str, ...]:
    """The plain words of a pattern that stand outside its groups: each of its matches holds them all."""
    plain = pattern.replace(" ?", "?")
    while True:
        shorter = _GROUP.sub(lambda m: " " * m[1].startswith(" ") + "#" + " " * m[1].endswith(" "), plain)
        if shorter == plain:
            return tuple(w for w in plain.split() if w.isalnum())
        plain = shorter


def split_up(pattern: str) -> list[str]:
    """A pattern, or if it has no plain word and begins with a group, one for each alternative of it."""
    if keywords(pattern) or not pattern.startswith("(?:"):
        return [pattern]
    depth, parts, start = 0, [], 3
    for k, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if (c == "|" and depth == 1) or not depth:
            parts.append(pattern[start:k])
            start = k + 1
        if not depth:
            return [x for part in parts for x in split_up(part + pattern[k + 1:])]
    return [pattern]
