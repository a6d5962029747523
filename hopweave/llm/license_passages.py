"""Signatures written by hand: sentences of licence texts, notices at the head of files, and notices of ownership.

Each line is a label, a rare word that every match holds, and a pattern over lower-cased words joined by single spaces.
"""

from __future__ import annotations

LATER = r"(?: of the license)?(?: or (?:at your option )?any later version)?"
GNU = r"you can redistribute it and or modify it under the terms of the gnu {kind}general public license(?: version {n})? as published by the free software foundation"


def _gnu(label: str, word: str, kind: str, number: str) -> tuple[tuple[str, str, str], ...]:
    """The notice of the GNU licences in a file, with its version before or after the publisher."""
    notice = GNU.format(kind=kind, n=number)
    return (
        (label, word, rf"{notice} (?:either )?version {number}{LATER}"),
        (label, word, rf"under the terms of version {number} of the gnu {kind}general public license"),
        (label, word, rf"gnu {kind}general public license(?: version)? {number} as published by the free software foundation"),
    )


SIGNATURES = (
    # MIT and its kin
    ("MIT", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction"),
    ("MIT", "sublicense", r"the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("MIT", "substantial", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("MIT", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("MIT", "holders", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("MIT", "mit", r"use of this source code is governed by an mit style licen[sc]e"),
    ("NCSA", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal with the software without restriction"),
    ("X11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("JSON", "evil", r"the software shall be used for good not evil"),
    ("BSL-1.0", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("BSL-1.0", "boost", r"distributed under the boost software license version 1 0"),
    ("ISC", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("HPND", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("Beerware", "stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("Fair", "usage", r"usage of the works is permitted provided that this instrument is retained with the works"),
    # BSD
    ("BSD", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("BSD-3-Clause", "endorse", r"neither the names? of (?:\w+ ){1,8}nor the names of (?:its|his|their) contributors may be used to endorse or promote products derived from this software"),
    ("BSD-3-Clause", "endorse", r"the name of the author may not be used to endorse or promote products derived from this software"),
    ("BSD-3-Clause-Clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("BSD-4-Clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("BSD-2-Clause-Views", "views", r"the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted"),
    ("BSD", "bsd", r"use of this source code is governed by a bsd style licen[sc]e"),
    # Apache
    ("Apache-2.0", "apache", r"licensed under the apache license version 2 0(?: the license)? you may not use this (?:file|work|software) except in compliance with the license"),
    ("Apache-2.0", "apache", r"(?:https? )?www apache org licenses license 2 0(?: txt| html)?"),
    ("Apache-2.0", "unless", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("Apache-2.0", "irrevocable", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("Apache-2.0", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("Apache-1.1", "apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    # GNU
    *_gnu("GPL-2.0", "general", "", "2"), *_gnu("GPL-3.0", "general", "", "3"),
    *_gnu("LGPL-2.1", "lesser", "lesser ", "2 1"), *_gnu("LGPL-3.0", "lesser", "lesser ", "3"), *_gnu("LGPL-2.0", "library", "library ", "2"),
    *_gnu("AGPL-3.0", "affero", "affero ", "3"),
    ("GPL", "along", r"you should have received a copy of the gnu general public license along with this (?:program|file|software|package)"),
    ("LGPL", "along", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|file|software|package)"),
    ("AGPL-3.0", "along", r"you should have received a copy of the gnu affero general public license along with this (?:program|file|software|package)"),
    ("GPL-2.0", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("GPL-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("AGPL-3.0", "cooperation", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("LGPL-2.1", "specially", r"this license the lesser general public license applies to some specially designated software packages"),
    ("LGPL-3.0", "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("GFDL", "textbook", r"the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom"),
    ("GFDL", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("FSFULLR", "unlimited", r"this file is free software the free software foundation gives unlimited permission to copy and or distribute it with or without modifications"),
    ("GPL-with-classpath-exception", "classpath", r"(?:gnu )?general public license(?: version)? 2 with (?:the )?classpath exception"),
    # Mozilla, Eclipse, Sun and IBM
    ("MPL-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MPL-2.0", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("MPL-2.0", "incompatible", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("MPL-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("MPL-1.0", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("EPL-2.0", "eclipse", r"made available under the terms of the eclipse public license v?(?:ersion )? ?2 0"),
    ("EPL-1.0", "eclipse", r"made available under the terms of the eclipse public license v?(?:ersion )? ?1 0"),
    ("EPL-2.0", "secondary", r"this source code may also be made available under the following secondary licenses"),
    ("CDDL-1.0", "distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("CPL-1.0", "accompanying", r"the accompanying program is provided under the terms of this common public license"),
    ("IPL-1.0", "ibm", r"the accompanying program is provided under the terms of this ibm public license"),
    # Short permissive texts
    ("Zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("Zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("Zlib", "liable", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("Unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("Unlicense", "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("CC0-1.0", "waived", r"to the extent possible under law (?:\w+ ){1,8}(?:has|have) waived all copyright and related or neighboring rights"),
    ("CC0-1.0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("CC", "redistribute", r"you are free to share copy and redistribute the material in any medium or format"),
    ("CC", "appropriate", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("CC-NC", "purposes", r"you may not use the material for commercial purposes"),
    ("CC-SA", "contributions", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("CC-ND", "remix", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("OFL-1.1", "font", r"this font software is licensed under the sil open font license"),
    ("OFL-1.1", "typefaces", r"no copy of one or more of the font software typefaces may be sold by itself"),
    ("Artistic-1.0", "intent", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("Artistic-2.0", "establishes", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("Artistic-1.0-Perl", "perl", r"under the same terms as perl itself"),
    ("Python-2.0", "psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("PHP-3.01", "php", r"this product includes php software freely available from"),
    ("OpenSSL", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("SSLeay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("PostgreSQL", "california", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("Ms-PL", "accept", r"if you use the software you accept this license if you do not accept the license do not use the software"),
    ("Ruby", "ruby", r"under the terms of ruby s license"),
    ("Vim", "charityware", r"vim is charityware"),
    ("ICU", "unicode", r"unicode data files and any associated documentation the data files or unicode software"),
    ("W3C", "w3c", r"w3c software (?:notice )?and (?:document )?license"),
    ("UPL-1.0", "universal", r"universal permissive license(?: version| v)?(?: 1 0)?"),
    ("CECILL", "cecill", r"governed by the cecill(?: [bc])? license under french law"),
    ("MulanPSL-2.0", "mulan", r"mulan psl v2|mulan permissive software license version 2"),
    ("EUPL-1.2", "eupl", r"licensed under the eupl"),
    ("Blue-Oak-1.0.0", "oak", r"blue oak model license(?: version)?(?: 1 0 0)?"),
    ("Hippocratic", "hippocratic", r"hippocratic license"),
    ("Parity", "parity", r"parity public license"),
    ("PolyForm", "polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use) license"),
    ("CPAL-1.0", "cpal", r"cpal(?: 1 0)?"),
    ("QPL-1.0", "qpl", r"qpl(?: 1 0)?"),
    # Source available and services
    ("SSPL-1.0", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("BUSL-1.1", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("Elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("Commons-Clause", "sell", r"the license does not grant to you the right to sell the software"),
    ("Llama-Community", "llama", r"llama(?: 2| 3)?(?: 1| 2| 3)? community license"),
    ("OpenRAIL", "restrictions", r"use based restrictions as referenced in paragraph"),
    # Data
    ("ODbL-1.0", "database", r"you are free to share to copy distribute and use the database"),
    ("ODC-PDDL-1.0", "pddl", r"pddl(?: 1 0)?"),
    ("OGL-UK-3.0", "government", r"open government licen[sc]e(?: v3 0)?"),
    ("CDLA", "cdla", r"cdla (?:permissive|sharing)(?: 1 0| 2 0)?"),
    ("US-Government", "government", r"this is a work of the u s government and is not subject to copyright protection in the united states"),
    # Ownership without a licence
    ("Proprietary", "confidential", r"this (?:software|document|file) (?:is|contains) (?:the )?confidential and proprietary information of"),
    ("Proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use) of this (?:file|document|material|software|work)(?: via any medium)? is (?:strictly )?prohibited"),
    ("Proprietary", "reproduced", r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("Proprietary", "prohibited", r"(?:redistribution|reproduction) (?:in whole or in part )?without (?:prior )?(?:written )?permission is prohibited"),
    ("Proprietary", "terms", r"subject to the terms of the end user license agreement"),
    ("Proprietary", "evaluation", r"licensed for evaluation purposes only"),
    ("Proprietary", "internal", r"for internal use only"),
    ("Public-Domain", "dedicated", r"(?:has been|is hereby) dedicated to the public domain"),
    ("Public-Domain", "renounces", r"the author hereby renounces all copyright"),
    ("SQLite-blessing", "blessing", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
)
