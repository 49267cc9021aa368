"""Licence signatures: label, keyword and regexes over a text's words, lower-cased and joined by one space.

A dot, hyphen or slash separates words, so version 2.0 reads "2 0" and LGPL-2.1 reads "lgpl 2 1". Rules are
in order: of two equally strong detections over the same words the earlier rule's stays.
"""

V = r"(?:version |v ?|ver )?"  # before a version number
L = r"(?:licen[cs]e )"
THE = r"(?:the )?"
LATER = r"(?: or (?:any |at your option any )?later(?: version)?|\+| or newer)?"

#: Sentences of licence texts themselves: the strongest evidence.
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction"),
    ("mit", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit-0", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", r"neither the name(?:s)? of .{1,80}? (?:nor|or) the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-1-clause", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided"),
    ("bsd-protection", r"bsd protection license february 2002"),
    ("apache-2.0", r"licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license"),
    ("apache-2.0", r"apache license version 2 0 january 2004.{0,60}? terms and conditions for use reproduction and distribution"),
    ("apache-1.1", r"the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache"),
    ("gpl-2.0", r"gnu general public license version 2 june 1991"),
    ("gpl-3.0", r"gnu general public license version 3 29 june 2007"),
    ("gpl", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0-or-later", r"published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", r"published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-only", r"published by the free software foundation version 2 of the license"),
    ("lgpl", r"redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2.0", r"gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", r"gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", r"gnu affero general public license version 3 19 november 2007"),
    ("agpl", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("epl-2.0", r"the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("epl-1.0", r"the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl-1.0", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("artistic-2.0", r"you may distribute verbatim copies of the source form of the standard version of this package"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1"),
    ("cc0-1.0", r"has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", r"dedicates? (?:this work|any and all copyright interest) to the public domain"),
    ("public-domain", r"(?:is|are|released|placed|put|been dedicated) (?:in|into|to) the public domain"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("postgresql", r"postgresql is released under the postgresql license"),
    ("psf-2.0", r"this license agreement is between the python software foundation"),
    ("ms-pl", r"microsoft public license ms pl this license governs use of the accompanying software"),
    ("json", r"the software shall be used for good not evil"),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("proprietary", r"proprietary and confidential(?: information)?|confidential and proprietary(?: information)?"),
    ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)"),
    ("proprietary", r"(?:no part of this|this) .{1,60}? may not be reproduced|no part of .{1,60}? may be reproduced"),
]

#: Names of licences, as texts mention them. A notice such as "licensed under" before the name makes it stronger.
NAMES = [
    ("apache-2.0", rf"apache (?:software )?{L}?{V}2(?: 0)?", r"asl 2 0|apache2"),
    ("apache-1.1", rf"apache (?:software )?{L}?{V}1 1", r"asl 1 1"),
    ("apache-1.0", rf"apache (?:software )?{L}?{V}1 0", r"asl 1 0"),
    ("apache", r"apache (?:software )?licen[cs]e", r"apache style licen[cs]e"),
    ("mit", r"mit (?:x11 )?licen[cs]e", r"mit licensed|x11 mit"),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?", r"mit 0 licen[cs]e"),
    ("isc", r"isc licen[cs]e", r"internet systems consortium licen[cs]e"),
    ("0bsd", r"(?:zero|0) clause bsd(?: licen[cs]e)?", r"bsd zero clause(?: licen[cs]e)?|0bsd"),
    ("bsd-1-clause", r"(?:1|one) clause bsd(?: licen[cs]e)?", r"bsd (?:1|one) clause(?: licen[cs]e)?"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)?", r"bsd (?:2|two) clause(?: licen[cs]e)?"),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)?", r"bsd (?:3|three) clause(?: licen[cs]e)?"),
    ("bsd-4-clause", r"(?:original|old|4 clause|four clause) bsd(?: licen[cs]e)?", r"bsd (?:4|four) clause(?: licen[cs]e)?"),
    ("bsd", r"bsd (?:style )?licen[cs]e", r"berkeley software distribution licen[cs]e"),
    ("gpl-1.0", rf"(?:gnu )?general public licen[cs]e {V}1(?: 0)?{LATER}|(?:gnu )?gpl {V}1(?: 0)?{LATER}", r"gplv1"),
    ("gpl-2.0", rf"(?:gnu )?general public licen[cs]e {V}2(?: 0)?{LATER}|(?:gnu )?gpl {V}2(?: 0)?{LATER}", r"gplv2|gpl2"),
    ("gpl-3.0", rf"(?:gnu )?general public licen[cs]e {V}3(?: 0)?{LATER}|(?:gnu )?gpl {V}3(?: 0)?{LATER}", r"gplv3|gpl3"),
    ("gpl", r"gnu general public licen[cs]e", r"gnu gpl|gpl licen[cs]ed?"),
    ("lgpl-2.0", rf"lgpl {V}2(?: 0)?{LATER}", r"lgplv2"),
    ("lgpl-2.1", rf"lgpl {V}2 1{LATER}", r"lgplv2 1"),
    ("lgpl-3.0", rf"lgpl {V}3(?: 0)?{LATER}", r"lgplv3"),
    ("lgpl-2.0", rf"(?:gnu )?library general public licen[cs]e(?: {V}2(?: 0)?)?{LATER}", r"gnu library gpl"),
    ("lgpl-2.1", rf"(?:gnu )?lesser general public licen[cs]e {V}2 1{LATER}", rf"gnu lesser gpl {V}2 1"),
    ("lgpl-3.0", rf"(?:gnu )?lesser general public licen[cs]e {V}3(?: 0)?{LATER}", rf"gnu lesser gpl {V}3"),
    ("lgpl", r"(?:gnu )?lesser general public licen[cs]e", r"gnu lesser gpl"),
    ("agpl-3.0", rf"(?:gnu )?affero general public licen[cs]e {V}3(?: 0)?{LATER}", rf"gnu affero gpl {V}3"),
    ("agpl-1.0", rf"affero general public licen[cs]e {V}1(?: 0)?{LATER}", rf"affero gpl {V}1"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", r"affero gpl"),
    ("agpl-3.0", rf"agpl {V}3(?: 0)?{LATER}", r"agplv3|agpl3"),
    ("gfdl-1.2", rf"gnu free documentation licen[cs]e {V}1 2{LATER}", rf"gfdl {V}1 2"),
    ("gfdl-1.3", rf"gnu free documentation licen[cs]e {V}1 3{LATER}", rf"gfdl {V}1 3"),
    ("gfdl", r"gnu free documentation licen[cs]e", r"gnu fdl"),
    ("gfdl", r"gfdl(?: 1 [123])?", r"gfdl licen[cs]ed?"),
    ("cc-by-nc-nd", rf"cc by nc nd(?: {V}[1-4](?: [05])?)?", r"cc by nc nd unported"),
    ("cc-by-nc-sa", rf"cc by nc sa(?: {V}[1-4](?: [05])?)?", r"cc by nc sa unported"),
    ("cc-by-nc", rf"cc by nc(?: {V}[1-4](?: [05])?)?", r"cc by nc unported"),
    ("cc-by-nd", rf"cc by nd(?: {V}[1-4](?: [05])?)?", r"cc by nd unported"),
    ("cc-by-sa", rf"cc by sa(?: {V}[1-4](?: [05])?)?", r"cc by sa unported"),
    ("cc-by", rf"cc by(?: {V}[1-4](?: [05])?)?", r"cc by unported"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", r"creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", r"creative commons by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] [05])?", r"creative commons by nc(?: [1-4] [05])?"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", r"creative commons by nd(?: [1-4] [05])?"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] [05])?", r"creative commons by sa(?: [1-4] [05])?"),
    ("cc-by", r"creative commons attribution(?: [1-4] [05])?", r"creative commons by(?: [1-4] [05])?"),
    ("cc0-1.0", r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?", r"creative commons public domain dedication"),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 (?:licen[cs]ed?|waiver)"),
    ("cc-pdm", r"(?:creative commons )?public domain mark(?: 1 0)?", r"cc pdm"),
    ("cc", r"creative commons licen[cs]e", r"creative commons"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd(?: [1-4] [05])?", r"by nc nd [1-4] [05] creativecommons"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa(?: [1-4] [05])?", r"by nc sa [1-4] [05] creativecommons"),
    ("cc-by-nc", r"creativecommons org licenses by nc(?: [1-4] [05])?", r"by nc [1-4] [05] creativecommons"),
    ("cc-by-nd", r"creativecommons org licenses by nd(?: [1-4] [05])?", r"by nd [1-4] [05] creativecommons"),
    ("cc-by-sa", r"creativecommons org licenses by sa(?: [1-4] [05])?", r"by sa [1-4] [05] creativecommons"),
    ("cc-by", r"creativecommons org licenses by(?: [1-4] [05])?", r"by [1-4] [05] creativecommons"),
    ("cc0-1.0", r"creativecommons org publicdomain zero(?: 1 0)?", r"publicdomain zero 1 0"),
    ("mpl-1.0", rf"mozilla public licen[cs]e {V}1 0", rf"mpl {V}1 0"),
    ("mpl-1.1", rf"mozilla public licen[cs]e {V}1 1", rf"mpl {V}1 1"),
    ("mpl-2.0", rf"mozilla public licen[cs]e {V}2(?: 0)?", rf"mpl {V}2(?: 0)?"),
    ("mpl", r"mozilla public licen[cs]e", r"mozilla licen[cs]e"),
    ("npl-1.1", r"netscape public licen[cs]e(?: version)? 1 1", r"npl 1 1"),
    ("npl-1.0", r"netscape public licen[cs]e(?: version 1 0)?", r"npl 1 0"),
    ("epl-1.0", rf"eclipse public licen[cs]e {V}1(?: 0)?", rf"epl {V}1 0"),
    ("epl-2.0", rf"eclipse public licen[cs]e {V}2(?: 0)?", rf"epl {V}2 0"),
    ("edl-1.0", r"eclipse distribution licen[cs]e(?: v1 0| 1 0)?", r"edl 1 0"),
    ("cpl-1.0", r"common public licen[cs]e(?: v1 0| version 1 0| 1 0)?", r"cpl 1 0"),
    ("ipl-1.0", r"ibm public licen[cs]e(?: version)?(?: 1 0)?", r"ipl 1 0"),
    ("cddl-1.1", r"common development and distribution licen[cs]e(?: version)? 1 1", r"cddl 1 1"),
    ("cddl-1.0", r"common development and distribution licen[cs]e(?: version)?(?: 1 0)?", r"cddl 1 0"),
    ("cddl", r"cddl(?: licen[cs]e)?(?: 1 [01])?", r"cddl gpl"),
    ("artistic-1.0", rf"artistic licen[cs]e {V}1(?: 0)?", r"perl artistic licen[cs]e"),
    ("artistic-2.0", rf"artistic licen[cs]e {V}2(?: 0)?", r"artistic 2 0"),
    ("artistic", r"artistic licen[cs]e", r"same terms as perl itself"),
    ("perl", r"(?:under )?(?:the )?same terms as perl(?: itself)?", r"perl licen[cs]e"),
    ("bsl-1.0", r"boost software licen[cs]e(?: version)?(?: 1 0)?", r"boost licen[cs]e"),
    ("busl-1.1", r"business source licen[cs]e(?: version)?(?: 1 1)?", r"busl 1 1"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib licensed"),
    ("libpng", r"libpng licen[cs]e", r"png reference library licen[cs]e"),
    ("unlicense", r"the unlicense", r"unlicense org"),
    ("wtfpl", r"wtfpl(?: (?:version |v)?2)?", r"do what the fuck you want to public licen[cs]e"),
    ("ofl-1.1", r"(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?", r"sil ofl(?: 1 1)?"),
    ("ofl-1.0", r"(?:sil )?open font licen[cs]e(?: version)? 1 0", r"sil ofl 1 0"),
    ("eupl-1.1", rf"european union public licen[cs]e {V}1 1", rf"eupl {V}1 1"),
    ("eupl-1.2", rf"european union public licen[cs]e(?: {V}1 2)?", rf"eupl {V}1 2"),
    ("eupl", r"eupl(?: 1 [012])?", r"eupl licen[cs]ed?"),
    ("cecill-2.1", r"cecill (?:version |v)?2 1", r"cecill licen[cs]e version 2 1"),
    ("cecill-b", r"cecill b(?: licen[cs]e)?", r"licen[cs]e cecill b"),
    ("cecill-c", r"cecill c(?: licen[cs]e)?", r"licen[cs]e cecill c"),
    ("cecill", r"cecill(?: licen[cs]e)?", r"licen[cs]e cecill"),
    ("ms-pl", r"microsoft public licen[cs]e", r"ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", r"ms rl"),
    ("apsl-2.0", r"apple public source licen[cs]e(?: version)?(?: 2 0)?", r"apsl 2 0"),
    ("afl-3.0", r"academic free licen[cs]e(?: version| v)?(?: ?[123] [01])?", r"afl 3 0"),
    ("osl-3.0", r"open software licen[cs]e(?: version| v)?(?: ?[123] [01])?", r"osl 3 0"),
    ("upl-1.0", r"universal permissive licen[cs]e(?: v1 0| version 1 0| 1 0)?", r"upl 1 0"),
    ("ncsa", r"university of illinois(?: ncsa)? open source licen[cs]e", r"ncsa open source licen[cs]e"),
    ("postgresql", r"postgresql licen[cs]e", r"postgres licen[cs]e"),
    ("php-3.01", r"php licen[cs]e(?: version)?(?: 3 0 ?1)?", r"php 3 01"),
    ("psf-2.0", r"python software foundation licen[cs]e(?: version)?(?: 2)?", r"psf licen[cs]e"),
    ("python-2.0", r"python licen[cs]e(?: version)?(?: 2 0)?", r"cnri python licen[cs]e"),
    ("ruby", r"ruby licen[cs]e", r"same terms as ruby"),
    ("ftl", r"freetype (?:project )?licen[cs]e", r"ftl licen[cs]e"),
    ("openssl", r"openssl licen[cs]e", r"openssl ssleay licen[cs]e"),
    ("vim", r"vim licen[cs]e", r"vim charityware"),
    ("w3c", r"w3c (?:software|document)(?: notice and)? licen[cs]e", r"w3c licen[cs]e"),
    ("odbl-1.0", r"(?:odc )?open database licen[cs]e(?: v?1 0)?", r"odbl(?: 1 0)?"),
    ("odc-by-1.0", r"open data commons attribution licen[cs]e(?: v?1 0)?", r"odc by(?: 1 0)?"),
    ("pddl-1.0", r"(?:odc )?public domain dedication and licen[cs]e(?: 1 0)?", r"pddl(?: 1 0)?"),
    ("cdla-permissive-2.0", r"community data licen[cs]e agreement permissive(?: version)?(?: [12] 0)?", r"cdla permissive(?: [12] 0)?"),
    ("cdla-sharing-1.0", r"community data licen[cs]e agreement sharing(?: version)?(?: 1 0)?", r"cdla sharing(?: 1 0)?"),
    ("ogl-uk-3.0", r"open government licen[cs]e(?: v3 0| version 3 0| 3 0)?", r"ogl uk 3 0"),
    ("etalab-2.0", r"licence ouverte(?: etalab)?(?: 2 0)?", r"etalab 2 0"),
    ("dl-de-by-2.0", r"datenlizenz deutschland(?: namensnennung)?(?: 2 0)?", r"dl de by 2 0"),
    ("mulan-psl-2.0", r"mulan (?:psl|permissive software licen[cs]e)(?: v?2(?: 0)?)?", r"mulanpsl 2 0"),
    ("sspl-1.0", r"server side public licen[cs]e(?: v?1(?: 0)?)?", r"sspl(?: 1 0)?"),
    ("elastic-2.0", r"elastic licen[cs]e(?: v?2(?: 0)?)?", r"elv2"),
    ("commons-clause", r"commons clause(?: licen[cs]e condition)?(?: v1 0)?", r"commons clause restriction"),
    ("polyform-nc-1.0", r"polyform noncommercial licen[cs]e(?: 1 0 0)?", r"polyform noncommercial"),
    ("openrail", r"(?:bigscience )?open ?rail(?: m| s)?(?: licen[cs]e)?", r"responsible ai licen[cs]e"),
    ("llama-community", r"llama (?:[23](?: [123])? )?community licen[cs]e(?: agreement)?", r"llama licen[cs]e"),
    ("jpl-image", r"jpl image use policy", r"courtesy nasa jpl"),
    ("fair", r"fair licen[cs]e", r"usage of the works is permitted provided that this instrument is retained"),
    ("ecl-2.0", r"educational community licen[cs]e(?: version)?(?: 2 0)?", r"ecl 2 0"),
    ("qpl-1.0", r"q public licen[cs]e(?: version)?(?: 1 0)?", r"qpl 1 0"),
    ("sleepycat", r"sleepycat (?:public )?licen[cs]e", r"sleepycat software product licen[cs]e"),
    ("tcl", r"tcl(?: tk)? licen[cs]e", r"tcl bsd licen[cs]e"),
    ("latex-1.3c", r"latex project public licen[cs]e(?: version)?(?: 1 3c?)?", r"lppl(?: 1 3c?)?"),
    ("bitstream-vera", r"bitstream vera (?:fonts? )?(?:licen[cs]e|copyright)", r"bitstream vera derivative"),
    ("rights-notice", r"(?:all|some|no) rights reserved", r"rights reserved by"),
    ("proprietary", r"proprietary licen[cs]e", r"proprietary software licen[cs]e"),
    ("commercial", r"commercial licen[cs]e(?: agreement)?", r"under a commercial licen[cs]e"),
    ("freeware", r"freeware licen[cs]e", r"distributed as freeware"),
    ("shareware", r"shareware licen[cs]e", r"distributed as shareware"),
    ("eula", r"end user licen[cs]e agreement", r"eula"),
    ("copyright-notice", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*", r"copyright holders? .{1,40}? all rights reserved"),
]

#: Words before a name that make it a statement about the text at hand.
NOTICE = r"(?:licen[cs]ed|released|distributed|available|published|provided|shared|covered) (?:only )?(?:under|by|with) (?:a |an |the )?(?:terms of )?(?:the )?"
#: Machine-readable tags: the label is the tag itself.
SPDX = r"spdx license identifier (?P<tag>[a-z0-9]+(?: [0-9a-z]+){0,5})"
