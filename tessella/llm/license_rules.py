"""The signature rules: regexes over lower-case words with one blank between them.

A rule is (label, regex, keyword, priority). Every match of the regex holds the keyword as the
start of one of its words. Priority 3 is a named text or tag, 2 a named licence, 1 a hint.
NAMED, TAGGED and WORDING are written one by one; families of versions once, and expanded.
"""

from __future__ import annotations

#: (label, regex, keyword, priority)
NAMED = [
    ("mit", r"under the mit licen[sc]e", "mit", 3),
    ("mit", r"mit licen[sc]e", "mit", 2),
    ("mit", r"licen[sc]ed under mit", "mit", 2),
    ("mit", r"spdx licen[sc]e identifier mit", "spdx", 3),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "permission", 3),
    ("mit", r"expat licen[sc]e", "expat", 2),
    ("mit-0", r"mit no attribution(?: licen[sc]e)?", "mit", 3),
    ("mit-0", r"spdx licen[sc]e identifier mit 0", "spdx", 3),
    ("x11", r"x11 licen[sc]e", "x11", 2),
    ("isc", r"isc licen[sc]e", "isc", 2),
    ("isc", r"spdx licen[sc]e identifier isc", "spdx", 3),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission", 3),
    ("apache", r"apache(?: software)? licen[sc]e", "apache", 1),
    ("apache", r"apache licen[sc]ed", "apache", 1),
    ("apache-2", r"apache licen[sc]e version 2", "apache", 3),
    ("apache-2", r"spdx licen[sc]e identifier apache 2 0", "spdx", 3),
    ("apache-2", r"you may not use this file except in compliance with the licen[sc]e", "licen", 2),
    ("bsd", r"bsd licen[sc]ed?", "bsd", 1),
    ("bsd", r"bsd style licen[sc]e", "bsd", 1),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 2),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors", "neither", 3),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising", 3),
    ("0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[sc]e)?", "(?:bsd|0bsd)", 3),
    ("unlicense", r"(?:the )?unlicense", "unlicen", 2),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 3),
    ("public-domain", r"(?:in|into|to) the public domain", "domain", 1),
    ("public-domain", r"public domain (?:dedication|work|mark)", "domain", 2),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0", 3),
    ("cc0", r"cc zero", "cc", 2),
    ("cc0", r"creative commons zero", "creative", 3),
    ("cc", r"creative commons(?: licen[sc]e)?", "creative", 1),
    ("wtfpl", r"wtfpl", "wtfpl", 2),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e", "fuck", 3),
    ("zlib", r"zlib licen[sc]e", "zlib", 2),
    ("zlib", r"zlib libpng licen[sc]e", "zlib", 3),
    ("libpng", r"libpng licen[sc]e", "libpng", 2),
    ("bsl-1.0", r"boost software licen[sc]e(?: version 1 0)?", "boost", 3),
    ("bsl-1.0", r"spdx licen[sc]e identifier bsl 1 0", "spdx", 3),
    ("ms-pl", r"microsoft public licen[sc]e", "microsoft", 3),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", "microsoft", 3),
    ("openssl", r"openssl licen[sc]e", "openssl", 2),
    ("python", r"python software foundation licen[sc]e", "python", 2),
    ("psf-2", r"psf licen[sc]e(?: agreement)? version 2", "psf", 3),
    ("php", r"php licen[sc]e", "php", 2),
    ("ruby", r"ruby licen[sc]e", "ruby", 2),
    ("postgresql", r"postgresql licen[sc]e", "postgresql", 2),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e", "ncsa", 2),
    ("ofl", r"(?:sil )?open font licen[sc]e", "font", 2),
    ("ofl-1.1", r"(?:sil )?open font licen[sc]e version 1 1", "font", 3),
    ("odbl", r"open (?:data commons open )?database licen[sc]e", "database", 3),
    ("odc-by", r"open data commons attribution licen[sc]e", "attribution", 3),
    ("pddl", r"public domain dedication and licen[sc]e", "domain", 3),
    ("gfdl", r"gnu free documentation licen[sc]e", "gnu", 3),
    ("gpl", r"gnu general public licen[sc]e", "gnu", 1),
    ("gpl", r"gpl licen[sc]ed?", "gpl", 1),
    ("gpl", r"under the (?:terms of the )?gpl", "gpl", 1),
    ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e", "gnu", 2),
    ("lgpl", r"lgpl", "lgpl", 1),
    ("agpl", r"gnu affero general public licen[sc]e", "gnu", 2),
    ("agpl", r"agpl", "agpl", 1),
    ("mpl", r"mozilla public licen[sc]e", "mozilla", 1),
    ("epl", r"eclipse public licen[sc]e", "eclipse", 1),
    ("cddl", r"common development and distribution licen[sc]e", "licen", 1),
    ("cpl", r"common public licen[sc]e", "licen", 1),
    ("ipl", r"ibm public licen[sc]e", "ibm", 2),
    ("eupl", r"european union public licen[sc]e", "european", 1),
    ("artistic", r"artistic licen[sc]e", "artistic", 1),
    ("afl", r"academic free licen[sc]e", "academic", 1),
    ("osl", r"open software licen[sc]e", "licen", 1),
    ("ecl", r"educational community licen[sc]e", "educational", 1),
    ("busl-1.1", r"business source licen[sc]e(?: 1 1)?", "licen", 2),
    ("sspl", r"server side public licen[sc]e", "licen", 2),
    ("elastic", r"elastic licen[sc]e", "elastic", 2),
    ("commons-clause", r"commons clause(?: licen[sc]e condition)?", "commons", 2),
    ("polyform", r"polyform \S+ licen[sc]e", "polyform", 2),
    ("openrail", r"open ?rail(?: m)?(?: licen[sc]e)?", "(?:rail|openrail)", 2),
    ("upl-1.0", r"universal permissive licen[sc]e", "permissive", 2),
    ("vim", r"vim licen[sc]e", "vim", 2),
    ("tcl", r"tcl tk licen[sc]e", "tcl", 2),
    ("intel", r"intel open source licen[sc]e", "intel", 2),
    ("naist", r"naist licen[sc]e", "naist", 2),
    ("beerware", r"beer ?ware(?: licen[sc]e)?", "beer", 2),
    ("json", r"the software shall be used for good not evil", "evil", 3),
    ("all-rights-reserved", r"all rights reserved", "rights", 1),
    ("all-rights-reserved", r"alle rechte vorbehalten", "rechte", 1),
    ("all-rights-reserved", r"tous droits réservés", "droits", 1),
    ("all-rights-reserved", r"todos los derechos reservados", "derechos", 1),
    ("proprietary", r"proprietary and confidential", "proprietary", 2),
    ("proprietary", r"(?:unauthori[sz]ed|strictly) (?:copying|reproduction|distribution)(?: of this file)?(?: \S+){0,6} (?:is )?(?:strictly )?prohibited", "prohibited", 2),
    ("proprietary", r"end user licen[sc]e agreement", "agreement", 2),
    ("proprietary", r"commercial licen[sc]e", "commercial", 1),
    ("non-commercial", r"(?:for )?non ?commercial (?:use|purposes)(?: only)?", "(?:commercial|noncommercial)", 1),
    ("copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?", "copyright", 1),
    ("copyright", r"copyright(?: c)? by", "copyright", 1),
    ("reference", r"(?:see|read) the licen[sc]e file(?: for details)?", "licen", 1),
    ("reference", r"released under (?:an?|the) (?:open source|free software) licen[sc]e", "licen", 1),
]

#: Identifiers of the common short-form tag, written out by hand.
TAGGED = [
    ("bsd-1-clause", r"bsd 1 clause"), ("bsd-2-clause", r"bsd 2 clause"), ("bsd-2-clause-patent", r"bsd 2 clause patent"), ("bsd-3-clause", r"bsd 3 clause"),
    ("bsd-3-clause-clear", r"bsd 3 clause clear"), ("bsd-4-clause", r"bsd 4 clause"), ("0bsd", r"0bsd"), ("unlicense", r"unlicense"), ("wtfpl", r"wtfpl"), ("zlib", r"zlib"),
    ("cc0", r"cc0 1 0"), ("cc-pddc", r"cc pddc"), ("ncsa", r"ncsa"), ("postgresql", r"postgresql"), ("upl-1.0", r"upl 1 0"), ("ms-pl", r"ms pl"), ("ms-rl", r"ms rl"),
    ("blueoak-1.0.0", r"blueoak 1 0 0"), ("hpnd", r"hpnd"), ("icu", r"icu"), ("ijg", r"ijg"), ("imagemagick", r"imagemagick"), ("json", r"json"), ("libpng", r"libpng(?: 2 0)?"),
    ("libtiff", r"libtiff"), ("mulan-psl", r"mulanpsl [12] 0"), ("openssl", r"openssl"), ("python", r"python 2 0"), ("psf-2", r"psf 2 0"), ("ruby", r"ruby"), ("sleepycat", r"sleepycat"),
    ("tcl", r"tcl"), ("vim", r"vim"), ("x11", r"x11"), ("ofl-1.1", r"ofl 1 1"), ("odbl", r"odbl 1 0"), ("odc-by", r"odc by 1 0"), ("pddl", r"pddl 1 0"), ("ftl", r"ftl"), ("curl", r"curl"),
    ("bzip2", r"bzip2 1 0 6"), ("info-zip", r"info zip"), ("mit-cmu", r"mit cmu"), ("mit-modern", r"mit modern variant"), ("beerware", r"beerware"), ("fair", r"fair"), ("intel", r"intel"),
    ("miros", r"miros"), ("ntp", r"ntp"), ("simpl", r"simpl 2 0"), ("xnet", r"xnet"), ("artistic", r"artistic 1 0 perl"), ("classpath-exception", r"gpl 2 0 with classpath exception"),
    ("llvm-exception", r"apache 2 0 with llvm exception"), ("noassertion", r"noassertion"), ("licenseref", r"licenseref \S+"),
]

#: Sentences of licence texts, notices and terms.
WORDING = [
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial", 3),
    ("mit", r"distribute sublicense and or sell copies of the software", "sublicen", 2),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "liability", 2),
    ("mit-style", r"mit style licen[sc]e", "mit", 2),
    ("mit", r"distributed under (?:the )?mit", "mit", 1),
    ("mit", r"dual licen[sc]ed under (?:the )?mit", "mit", 2),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", "permission", 3),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software", "disclaim", 2),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose", "permission", 3),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions", 3),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions", 3),
    ("bsd", r"use of this source code is governed by a bsd style licen[sc]e", "bsd", 3),
    ("bsd", r"bsd licen[sc]e that can be found in the licen[sc]e file", "bsd", 3),
    ("bsd-3-clause", r"new bsd licen[sc]e", "bsd", 3),
    ("bsd-3-clause", r"modified bsd licen[sc]e", "bsd", 3),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission", "endorse", 3),
    ("bsd-2-clause", r"simplified bsd licen[sc]e", "bsd", 3),
    ("bsd-2-clause", r"freebsd licen[sc]e", "freebsd", 3),
    ("bsd-4-clause", r"original bsd licen[sc]e", "bsd", 3),
    ("bsd-4-clause", r"this product includes software developed by", "software", 2),
    ("apache-2", r"licen[sc]ed under the apache licen[sc]e version 2 0", "apache", 3),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e", "unless", 3),
    ("apache-2", r"licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements", "apache", 3),
    ("apache-2", r"apache org licen[sc]es licen[sc]e 2 0", "apache", 3),
    ("apache-2", r"grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e", "patent", 2),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache", 3),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", "gnu", 3),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e", "gnu", 3),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e", "gnu", 3),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document", "verbatim", 3),
    ("gpl", r"gnu org licen[sc]es gpl", "gnu", 2),
    ("gpl", r"distributed under the gnu gpl", "gnu", 2),
    ("gpl", r"gnu gpl", "gnu", 1),
    ("gpl", r"gpl compatible", "gpl", 1),
    ("classpath-exception", r"classpath exception", "classpath", 2),
    ("gcc-exception", r"gcc runtime library exception", "gcc", 3),
    ("linking-exception", r"as a special exception (?:\S+ ){0,12}permission to link", "exception", 2),
    ("bison-exception", r"bison exception", "bison", 2),
    ("font-exception", r"gpl font exception", "gpl", 2),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", "gnu", 3),
    ("lgpl", r"gnu org licen[sc]es lgpl", "gnu", 2),
    ("agpl", r"gnu org licen[sc]es agpl", "gnu", 2),
    ("agpl", r"remote network interaction", "remote", 1),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant", 3),
    ("mpl", r"this source code form is subject to the terms of the mozilla public licen[sc]e", "mozilla", 3),
    ("mpl", r"mozilla org mpl", "mozilla", 2),
    ("mpl", r"the contents of this file are subject to the mozilla public licen[sc]e", "mozilla", 3),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "eclipse", 3),
    ("edl", r"eclipse distribution licen[sc]e", "eclipse", 3),
    ("epl", r"eclipse org legal epl", "eclipse", 2),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "licen", 3),
    ("unlicense", r"unlicense org", "unlicen", 3),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone", 3),
    ("public-domain", r"released into the public domain", "domain", 2),
    ("public-domain", r"placed in the public domain", "domain", 2),
    ("public-domain", r"dedicated to the public domain", "domain", 2),
    ("public-domain", r"no copyright is claimed", "copyright", 2),
    ("public-domain", r"united states government work", "government", 2),
    ("public-domain", r"gemeinfrei", "gemeinfrei", 2),
    ("public-domain", r"domaine public", "domaine", 1),
    ("public-domain", r"dominio p[uú]blico", "dominio", 1),
    ("cc0", r"to the extent possible under law (?:\S+ ){1,12}waived all copyright", "waived", 3),
    ("cc0", r"creativecommons org publicdomain zero 1 0", "creativecommons", 3),
    ("cc-pdm", r"creativecommons org publicdomain mark 1 0", "creativecommons", 3),
    ("cc", r"this work is licen[sc]ed under a creative commons", "creative", 2),
    ("cc", r"some rights reserved", "rights", 1),
    ("cc", r"licence creative commons", "creative", 1),
    ("cc", r"licencia creative commons", "creative", 1),
    ("cc", r"creative commons lizenz", "creative", 1),
    ("cc-sampling", r"creative commons sampling(?: plus)?", "creative", 2),
    ("cc-devnations", r"creative commons developing nations", "creative", 2),
    ("cc-by-sa", r"share alike licen[sc]e", "share", 1),
    ("cc-by-nc", r"attribution non ?commercial", "attribution", 2),
    ("cc-by-nd", r"attribution no ?derivatives", "attribution", 2),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "express", 3),
    ("zlib", r"altered source versions must be plainly marked as such", "altered", 3),
    ("bsl-1.0", r"boost org licen[sc]e 1 0", "boost", 3),
    ("bsl-1.0", r"use modification and distribution are subject to the boost software licen[sc]e", "boost", 3),
    ("wtfpl", r"you just do what the fuck you want to", "fuck", 3),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", "beer", 3),
    ("ftl", r"freetype (?:project )?licen[sc]e", "freetype", 2),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "jpeg", 3),
    ("curl", r"curl licen[sc]e", "curl", 2),
    ("info-zip", r"info zip licen[sc]e", "info", 2),
    ("icu", r"icu licen[sc]e", "icu", 2),
    ("sleepycat", r"sleepycat (?:public )?licen[sc]e", "sleepycat", 2),
    ("hpnd", r"historical permission notice and disclaimer", "historical", 3),
    ("ntp", r"ntp licen[sc]e", "ntp", 2),
    ("miros", r"miros licen[sc]e", "miros", 2),
    ("fair", r"usage of the works is permitted provided that this instrument is retained with the works", "usage", 3),
    ("blueoak-1.0.0", r"blue oak model licen[sc]e", "blue", 3),
    ("mulan-psl", r"mulan permissive software licen[sc]e", "mulan", 3),
    ("parity", r"parity public licen[sc]e", "parity", 2),
    ("prosperity", r"prosperity public licen[sc]e", "prosperity", 2),
    ("hippocratic", r"hippocratic licen[sc]e", "hippocratic", 2),
    ("anti-capitalist", r"anti capitalist software licen[sc]e", "capitalist", 3),
    ("cern-ohl", r"cern open hardware licen[sc]e", "cern", 3),
    ("cern-ohl", r"cern ohl [psw]", "cern", 2),
    ("tapr-ohl", r"tapr open hardware licen[sc]e", "tapr", 3),
    ("solderpad", r"solderpad hardware licen[sc]e", "solderpad", 3),
    ("ogl-uk", r"open government licen[sc]e(?: v ?\d(?: \d)?)?", "government", 3),
    ("etalab", r"licence ouverte(?: open licence)?", "ouverte", 2),
    ("dl-de", r"datenlizenz deutschland", "datenlizenz", 2),
    ("cdla", r"community data licen[sc]e agreement", "community", 2),
    ("cdla-permissive", r"community data licen[sc]e agreement permissive", "community", 3),
    ("cdla-sharing", r"community data licen[sc]e agreement sharing", "community", 3),
    ("o-uda", r"open use of data agreement", "agreement", 3),
    ("c-uda", r"computational use of data agreement", "computational", 3),
    ("openrail", r"responsible ai licen[sc]e", "responsible", 3),
    ("openrail", r"creativeml open rail", "creativeml", 3),
    ("ogl-game", r"open game licen[sc]e(?: version 1 0a?)?", "game", 2),
    ("orc", r"open rpg creative licen[sc]e", "rpg", 3),
    ("ubuntu-font", r"ubuntu font licen[sc]e", "ubuntu", 3),
    ("bitstream-vera", r"bitstream vera fonts? (?:copyright|licen[sc]e)", "bitstream", 3),
    ("ofl", r"scripts sil org ofl", "sil", 3),
    ("gust-font", r"gust font licen[sc]e", "gust", 3),
    ("free-art", r"(?:free art licen[sc]e|licence art libre)", "(?:free|licence)", 2),
    ("ms-lpl", r"microsoft limited public licen[sc]e", "microsoft", 3),
    ("ms-eula", r"microsoft software licen[sc]e terms", "microsoft", 3),
    ("oracle-bcl", r"oracle binary code licen[sc]e agreement", "oracle", 3),
    ("oracle-otn", r"oracle technology network licen[sc]e", "oracle", 3),
    ("java-research", r"java research licen[sc]e", "java", 3),
    ("ibm-ipla", r"ibm international program licen[sc]e agreement", "ibm", 3),
    ("nvidia-eula", r"nvidia software licen[sc]e agreement", "nvidia", 3),
    ("intel-simplified", r"intel simplified software licen[sc]e", "intel", 3),
    ("adobe-eula", r"adobe (?:general )?terms of use", "adobe", 2),
    ("timescale", r"community licen[sc]e agreement", "community", 2),
    ("confluent", r"confluent community licen[sc]e", "confluent", 3),
    ("redis-sal", r"source available licen[sc]e", "source", 2),
    ("fsl", r"functional source licen[sc]e", "functional", 3),
    ("fair-source", r"fair source licen[sc]e", "fair", 3),
    ("shareware", r"shareware licen[sc]e", "shareware", 2),
    ("freeware", r"freeware licen[sc]e", "freeware", 2),
    ("evaluation", r"evaluation licen[sc]e agreement", "evaluation", 2),
    ("evaluation", r"for evaluation purposes only", "evaluation", 1),
    ("non-commercial", r"not for commercial use", "commercial", 1),
    ("non-commercial", r"personal use only", "personal", 1),
    ("non-commercial", r"for (?:academic|educational|research) (?:use|purposes) only", "(?:academic|educational|research)", 2),
    ("no-derivatives", r"no derivative works", "derivative", 1),
    ("proprietary", r"confidential and proprietary", "proprietary", 2),
    ("proprietary", r"trade secrets? of", "trade", 1),
    ("proprietary", r"this document contains proprietary information", "proprietary", 2),
    ("proprietary", r"no part of this (?:publication|book|document|work) may be reproduced", "reproduced", 2),
    ("proprietary", r"without the (?:prior )?(?:express )?written (?:permission|consent) of", "written", 1),
    ("proprietary", r"by installing copying or otherwise using", "installing", 2),
    ("proprietary", r"you may not reverse engineer decompile or disassemble", "reverse", 2),
    ("proprietary", r"alle rechte liegen bei", "rechte", 1),
    ("proprietary", r"reproduction interdite", "reproduction", 1),
    ("proprietary", r"prohibida (?:la|su) reproducci[oó]n", "prohibida", 1),
    ("trademark", r"(?:registered )?trademarks? of (?:their|its) respective owners?", "trademark", 1),
    ("copyright", r"copyright holders?", "copyright", 1),
    ("copyright", r"urheberrechtlich gesch[uü]tzt", "urheberrechtlich", 1),
    ("copyright", r"droits d auteur", "droits", 1),
    ("copyright", r"derechos de autor", "derechos", 1),
    ("warranty-disclaimer", r"without warrant(?:y|ies) of any kind", "warrant", 1),
    ("warranty-disclaimer", r"provided as is", "provided", 1),
    ("cla", r"contributor licen[sc]e agreement", "contributor", 2),
    ("cla", r"developer certificate of origin", "developer", 2),
    ("reference", r"see (?:the )?copying(?: file)?", "copying", 1),
    ("reference", r"licen[sc]e terms (?:apply|below)", "licen", 1),
    ("reference", r"full licen[sc]e text", "licen", 1),
    ("reference", r"refer to the accompanying licen[sc]e", "licen", 1),
    ("reference", r"opensource org licen[sc]es \S+", "opensource", 2),
    ("reference", r"spdx org licen[sc]es \S+", "spdx", 2),
    ("reference", r"osi approved(?: licen[sc]e)?", "osi", 1),
]

#: family: (label, words of the name, keyword, versions)
VERSIONED = [
    ("gpl", r"(?:gnu )?(?:general public licen[sc]e|gpl)", "(?:general|gpl)", ["1", "2", "3"]),
    ("lgpl", r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)", "(?:lesser|library|lgpl)", ["2", "2.1", "3"]),
    ("agpl", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)", "(?:affero|agpl)", ["1", "3"]),
    ("gfdl", r"(?:gnu )?(?:free documentation licen[sc]e|gfdl)", "(?:documentation|gfdl)", ["1.1", "1.2", "1.3"]),
    ("apache", r"(?:apache(?: software)? licen[sc]e|asl)", "(?:apache|asl)", ["1.0", "1.1", "2.0"]),
    ("mpl", r"(?:mozilla public licen[sc]e|mpl)", "(?:mozilla|mpl)", ["1.0", "1.1", "2.0"]),
    ("epl", r"(?:eclipse public licen[sc]e|epl)", "(?:eclipse|epl)", ["1.0", "2.0"]),
    ("cddl", r"(?:common development and distribution licen[sc]e|cddl)", "(?:licen|cddl)", ["1.0", "1.1"]),
    ("eupl", r"(?:european union public licen[sc]e|eupl)", "(?:european|eupl)", ["1.0", "1.1", "1.2"]),
    ("artistic", r"artistic licen[sc]e", "artistic", ["1.0", "2.0"]),
    ("afl", r"(?:academic free licen[sc]e|afl)", "(?:academic|afl)", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("osl", r"(?:open software licen[sc]e|osl)", "(?:licen|osl)", ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    ("ecl", r"(?:educational community licen[sc]e|ecl)", "(?:educational|ecl)", ["1.0", "2.0"]),
    ("cpl", r"(?:common public licen[sc]e|cpl)", "(?:licen|cpl)", ["1.0"]),
    ("php", r"php licen[sc]e", "php", ["2.02", "3.0", "3.01"]),
    ("zpl", r"(?:zope public licen[sc]e|zpl)", "(?:zope|zpl)", ["1.1", "2.0", "2.1"]),
    ("lppl", r"(?:latex project public licen[sc]e|lppl)", "(?:latex|lppl)", ["1.0", "1.1", "1.2", "1.3"]),
    ("cecill", r"cecill(?: licen[sc]e)?", "cecill", ["1.0", "1.1", "2.0", "2.1"]),
    ("sspl", r"(?:server side public licen[sc]e|sspl)", "(?:licen|sspl)", ["1"]),
    ("elastic", r"elastic licen[sc]e", "elastic", ["1.0", "2.0"]),
    ("qpl", r"(?:q public licen[sc]e|qpl)", "(?:licen|qpl)", ["1.0"]),
    ("npl", r"netscape public licen[sc]e", "netscape", ["1.0", "1.1"]),
    ("nposl", r"non profit open software licen[sc]e", "profit", ["3.0"]),
    ("spl", r"sun public licen[sc]e", "licen", ["1.0"]),
    ("apsl", r"apple public source licen[sc]e", "apple", ["1.0", "1.1", "1.2", "2.0"]),
    ("w3c", r"w3c (?:software|document) (?:notice and )?licen[sc]e", "w3c", ["1998", "2015"]),
    ("unicode", r"unicode (?:data files and software )?licen[sc]e", "unicode", ["1", "3"]),
]

#: Creative Commons elements as they are abbreviated and as they are spelled.
CC_KINDS = [("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd")]
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
BSD_CLAUSES = {"1": "one", "2": "two", "3": "three", "4": "four"}


def rules() -> list[tuple[str, str, str, int]]:
    out = [*NAMED, *WORDING, *((label, rf"spdx licen[sc]e identifier {name}", "spdx", 3) for label, name in TAGGED)]
    for label, name, keyword, versions in VERSIONED:
        for v in versions:
            words = v.replace(".", " ")
            short = words.removesuffix(" 0")
            number = f"{short}(?: 0)?" if short != words or "." not in v else words
            shown = "apache-2" if (label, v) == ("apache", "2.0") else f"{label}-{v}"
            out.append((shown, rf"{name} (?:version |v ?)?{number}", keyword, 3))
            if label in ("gpl", "lgpl", "agpl", "gfdl"):
                out.append((f"{shown}-or-later", rf"{name} (?:version |v ?)?{number} or (?:\S+ \S+ option \S+ )?(?:any )?later(?: version)?", keyword, 3))
                out.append((f"{shown}-only", rf"{name} (?:version |v ?)?{number} only", keyword, 3))
            out.append((shown, rf"spdx licen[sc]e identifier {label} {number}", "spdx", 3))
    for kind in CC_KINDS:
        label, short, spelled = "-".join(("cc", *kind)), " ".join(kind), " ".join(CC_WORDS[k] for k in kind)
        out.append((label, rf"cc {short}", "cc", 2))
        out.append((label, rf"(?:creative commons )?{spelled}(?: licen[sc]e| international| unported)", "(?:creative|attribution)", 2))
        for v in CC_VERSIONS:
            words = v.replace(".", " ")
            out.append((f"{label}-{v}", rf"cc {short} {words}", "cc", 3))
            out.append((f"{label}-{v}", rf"creative commons {spelled}(?: licen[sc]e)? (?:version |v ?)?{words}", "creative", 3))
            out.append((f"{label}-{v}", rf"creativecommons org licen[sc]es {short} {words}", "creativecommons", 3))
    for n, word in BSD_CLAUSES.items():
        out.append((f"bsd-{n}-clause", rf"(?:{n}|{word}) clause bsd(?: licen[sc]e)?", "bsd", 3))
        out.append((f"bsd-{n}-clause", rf"bsd (?:{n}|{word}) clause(?: licen[sc]e)?", "bsd", 3))
    return out
