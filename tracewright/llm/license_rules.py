"""License scans with ordered signature rules.

A text becomes a line of lower-case words. Rules are regular expressions over that line; each names a word
that must occur, so most texts run no expression at all. Rules have a priority: of detections where one
interval contains the other, the one of higher priority stays (of equals the longer, then the earlier rule),
and one that did not stay displaces no other.
Base detections, the places of three fixed phrases, are never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import append_columns, table

# fixed values: phrases of the contract and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Rule(NamedTuple):
    name: str
    label: str
    keyword: str  # a word of every match that no rule of the same pattern with another keyword runs for
    pattern: str
    priority: int
    confidence: float


# label; names that a reference "under the <name> license" may use; SPDX words; a word of each name form
_NAMED = [
    ("mit", r"mit(?: x11)?|expat", r"mit", ["mit", "expat"]),
    ("apache-1", r"apache(?: software)? (?:license )?(?:version )?1 [01]", r"apache 1 [01]", ["apache"]),
    ("apache-2", r"apache(?: software)? (?:license )?(?:version |v)?2(?: 0)?", r"apache 2 0", ["apache"]),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause", r"bsd 2 clause", ["bsd"]),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause", r"bsd 3 clause", ["bsd"]),
    ("bsd-4-clause", r"(?:original|old|4 clause|four clause) bsd|bsd (?:4|four) clause", r"bsd 4 clause", ["bsd"]),
    ("0bsd", r"(?:zero clause|0 clause) bsd|bsd zero clause", r"0bsd", ["bsd", "0bsd"]),
    ("gpl-1", r"(?:gnu )?(?:gpl|general public license) (?:version |v)?1(?: 0)?", r"gpl 1 0(?: only| or later)?", ["gpl", "general"]),
    ("gpl-2", r"(?:gnu )?(?:gpl|general public license) (?:version |v)?2(?: 0)?", r"gpl 2 0(?: only| or later)?", ["gpl", "general"]),
    ("gpl-3", r"(?:gnu )?(?:gpl|general public license) (?:version |v)?3(?: 0)?", r"gpl 3 0(?: only| or later)?", ["gpl", "general"]),
    ("lgpl-2", r"(?:gnu )?(?:lgpl|library general public license) (?:version |v)?2(?: 0)?", r"lgpl 2 0(?: only| or later)?", ["lgpl", "library"]),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|lesser general public license) (?:version |v)?2 1", r"lgpl 2 1(?: only| or later)?", ["lgpl", "lesser"]),
    ("lgpl-3", r"(?:gnu )?(?:lgpl|lesser general public license) (?:version |v)?3(?: 0)?", r"lgpl 3 0(?: only| or later)?", ["lgpl", "lesser"]),
    ("agpl-3", r"(?:gnu )?(?:agpl|affero general public license) (?:version |v)?3(?: 0)?", r"agpl 3 0(?: only| or later)?", ["agpl", "affero"]),
    ("gfdl-1", r"(?:gnu )?(?:gfdl|free documentation license) (?:version |v)?1 [123]", r"gfdl 1 [123](?: only| or later)?", ["gfdl", "documentation"]),
    ("mpl-1", r"(?:mozilla public license|mpl) (?:version |v)?1 [01]", r"mpl 1 [01]", ["mozilla", "mpl"]),
    ("mpl-2", r"(?:mozilla public license|mpl) (?:version |v)?2(?: 0)?", r"mpl 2 0", ["mozilla", "mpl"]),
    ("epl-1", r"(?:eclipse public license|epl) (?:version |v)?1 0", r"epl 1 0", ["eclipse", "epl"]),
    ("epl-2", r"(?:eclipse public license|epl) (?:version |v)?2 0", r"epl 2 0", ["eclipse", "epl"]),
    ("cddl-1", r"(?:common development and distribution license|cddl) (?:version |v)?1 [01]", r"cddl 1 [01]", ["distribution", "cddl"]),
    ("cpl-1", r"(?:common public license|cpl) (?:version |v)?1 0", r"cpl 1 0", ["common", "cpl"]),
    ("eupl-1", r"(?:european union public licen[cs]e|eupl) (?:version |v)?1 [012]", r"eupl 1 [012]", ["european", "eupl"]),
    ("artistic-1", r"artistic license (?:version |v)?1 0", r"artistic 1 0", ["artistic"]),
    ("artistic-2", r"artistic license (?:version |v)?2(?: 0)?", r"artistic 2 0", ["artistic"]),
    ("bsl-1", r"boost software license(?: (?:version |v)?1 0)?", r"bsl 1 0", ["boost", "bsl"]),
    ("busl-1.1", r"business source license(?: (?:version |v)?1 1)?", r"busl 1 1", ["business", "busl"]),
    ("isc", r"isc", r"isc", ["isc"]),
    ("zlib", r"zlib(?: libpng)?", r"zlib", ["zlib"]),
    ("libpng", r"libpng", r"libpng(?: 2 0)?", ["libpng"]),
    ("ijg", r"independent jpeg group", r"ijg", ["jpeg", "ijg"]),
    ("unlicense", r"the unlicense|unlicense", r"unlicense", ["unlicense"]),
    ("wtfpl", r"wtfpl|do what the fuck you want to public license", r"wtfpl", ["wtfpl", "public"]),
    ("beerware", r"beer ?ware", r"beerware", ["beer", "beerware"]),
    ("ms-pl", r"microsoft public license|ms pl", r"ms pl", ["microsoft", "pl"]),
    ("ms-rl", r"microsoft reciprocal license|ms rl", r"ms rl", ["microsoft", "rl"]),
    ("osl-3", r"open software license (?:version |v)?3 0", r"osl 3 0", ["open", "osl"]),
    ("afl-3", r"academic free license (?:version |v)?3 0", r"afl 3 0", ["academic", "afl"]),
    ("ecl-2", r"educational community license (?:version |v)?2 0", r"ecl 2 0", ["educational", "ecl"]),
    ("ofl-1.1", r"(?:sil )?open font license(?: (?:version |v)?1 1)?", r"ofl 1 1", ["font", "ofl"]),
    ("python-2", r"(?:python software foundation|psf|python) license(?: (?:version |v)?2(?: 0)?)?", r"(?:psf|python) 2 0", ["python", "psf"]),
    ("ruby", r"ruby license", r"ruby", ["ruby"]),
    ("perl", r"same terms as perl(?: itself)?", r"artistic 1 0 perl", ["perl"]),
    ("php-3", r"php license (?:version |v)?3 0[01]?", r"php 3 0[01]?", ["php"]),
    ("openssl", r"openssl(?: ssleay)?", r"openssl", ["openssl"]),
    ("curl", r"curl license", r"curl", ["curl"]),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa", ["ncsa"]),
    ("w3c", r"w3c(?: software)?(?: notice)?(?: and)?", r"w3c", ["w3c"]),
    ("vim", r"vim license", r"vim", ["vim"]),
    ("upl-1", r"universal permissive license(?: (?:version |v)?1 0)?", r"upl 1 0", ["universal", "upl"]),
    ("postgresql", r"postgresql", r"postgresql", ["postgresql"]),
    ("odbl-1", r"open (?:database|data commons open database) license(?: 1 0)?", r"odbl 1 0", ["database", "odbl"]),
    ("odc-by-1", r"open data commons attribution license(?: 1 0)?", r"odc by 1 0", ["commons", "odc"]),
    ("pddl-1", r"public domain dedication and license(?: 1 0)?", r"pddl 1 0", ["dedication", "pddl"]),
    ("cc0-1", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0", ["cc0"]),
    ("cc-by", r"cc by(?: (?:version |v)?[1234] [05])?|creative commons attribution", r"cc by [1234] [05]", ["cc", "creative"]),
    ("cc-by-sa", r"cc by sa(?: [1234] [05])?|creative commons attribution share ?alike", r"cc by sa [1234] [05]", ["cc", "creative"]),
    ("cc-by-nd", r"cc by nd(?: [1234] [05])?|creative commons attribution no ?deriv(?:ative)?s?", r"cc by nd [1234] [05]", ["cc", "creative"]),
    ("cc-by-nc", r"cc by nc(?: [1234] [05])?|creative commons attribution non ?commercial", r"cc by nc [1234] [05]", ["cc", "creative"]),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1234] [05])?|creative commons attribution non ?commercial share ?alike", r"cc by nc sa [1234] [05]", ["cc", "creative"]),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1234] [05])?|creative commons attribution non ?commercial no ?deriv(?:ative)?s?", r"cc by nc nd [1234] [05]", ["cc", "creative"]),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict)(?: 1 0 0)?", r"polyform (?:noncommercial|small business) 1 0 0", ["polyform"]),
    ("sspl-1", r"server side public license(?: (?:version |v)?1)?", r"sspl 1 0", ["server", "sspl"]),
    ("elastic-2", r"elastic license(?: (?:version |v)?2(?: 0)?)?", r"elastic 2 0", ["elastic"]),
    ("openrail", r"(?:bigscience |creativeml )?(?:open ?rail(?: m)?|rail license)", r"openrail(?: m)?", ["openrail", "rail"]),
    ("blueoak-1", r"blue oak model license(?: 1 0 0)?", r"blueoak 1 0 0", ["oak", "blueoak"]),
]

# sentences of the license texts themselves, and their addresses
_TEXTS = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"),
    ("mit", "opensource", r"opensource org licenses? mit"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2", "apache", r"apache org licenses(?: license)? 2 0"),
    ("apache-2", "unless", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd-3-clause", "neither", r"neither the name of [^.]{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-2-clause", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", "version", r"gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3", "version", r"gnu general public license as published by the free software foundation either version 3"),
    ("gpl", "gnu", r"gnu org (?:licenses|copyleft)(?: gpl)?(?: html)?"),
    ("lgpl", "lesser", r"under the terms of the gnu lesser general public license"),
    ("lgpl", "library", r"under the terms of the gnu library general public license"),
    ("agpl-3", "affero", r"under the terms of the gnu affero general public license"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mpl", r"mozilla org mpl"),
    ("epl", "eclipse", r"eclipse org legal epl"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("bsl-1", "boost", r"boost org license 1 0 txt"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in)?to the public domain"),
    ("public-domain", "domain", r"in the public domain"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("cc0-1", "zero", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1234] [05]"),
    ("ofl-1.1", "sil", r"scripts sil org ofl"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("proprietary", "reserved", r"all rights reserved"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|distribution|reproduction)(?: of this (?:file|software|document))?"),
    ("non-commercial", "commercial", r"for non commercial (?:use|purposes) only"),
    ("non-commercial", "noncommercial", r"for noncommercial (?:use|purposes) only"),
    ("non-commercial", "research", r"for research (?:use|purposes) only"),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "disclaims", r"the software is provided as is and (?:the author|isc) disclaims all warranties with regard to this software"),
    ("apache-2", "derivative", r"you may reproduce and distribute copies of the work or derivative works thereof in any medium"),
    ("apache-2", "patent", r"perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent license"),
    ("apache-2", "contribution", r"any contribution intentionally submitted for inclusion in the work by you to the licensor"),
    ("bsd-2-clause", "binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "university", r"this product includes software developed by the university of"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "hope", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "exception", r"as a special exception the copyright holders give you permission to link"),
    ("gpl", "linking", r"linking this library statically or dynamically with other modules"),
    ("lgpl", "library", r"this library is free software you can redistribute it and or modify it"),
    ("agpl-3", "remotely", r"(?:users )?interacting with it remotely through a computer network"),
    ("gfdl-1", "invariant", r"with no invariant sections"),
    ("mpl-2", "secondary", r"this source code form is incompatible with secondary licenses"),
    ("mpl-1", "initial", r"the initial developer of the original code is"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl-1", "subject", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1", "agreement", r"this common public license agreement"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", "arising", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("libpng", "png", r"the png reference library is supplied as is"),
    ("bsl-1", "organization", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("artistic-2", "perl", r"the artistic license (?:2 0 )?as published by the perl foundation"),
    ("python-2", "licensee", r"psf is making python (?:2 |3 )?available to licensee on an as is basis"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("php-3", "php", r"this product includes php software"),
    ("curl", "curl", r"curl se docs copyright"),
    ("w3c", "w3c", r"w3c software notice and license"),
    ("ofl-1.1", "font", r"with reserved font name"),
    ("odbl-1", "opendatacommons", r"opendatacommons org licenses odbl"),
    ("odc-by-1", "opendatacommons", r"opendatacommons org licenses by"),
    ("pddl-1", "opendatacommons", r"opendatacommons org licenses pddl"),
    ("cc0-1", "waived", r"(?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("cc-by", "international", r"licensed under a creative commons attribution [1234] [05] international license"),
    ("cc-by-sa", "international", r"licensed under a creative commons attribution sharealike [1234] [05] international license"),
    ("cc-by-nd", "international", r"licensed under a creative commons attribution noderivatives [1234] [05] international license"),
    ("cc-by-nc", "international", r"licensed under a creative commons attribution noncommercial [1234] [05] international license"),
    ("cc-by-nc-sa", "international", r"licensed under a creative commons attribution noncommercial sharealike [1234] [05] international license"),
    ("cc-by-nc-nd", "international", r"licensed under a creative commons attribution noncommercial noderivatives [1234] [05] international license"),
    ("sspl-1", "mongodb", r"mongodb com licensing server side public license"),
    ("elastic-2", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "production", r"the licensor (?:hereby )?grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("polyform", "polyformproject", r"polyformproject org licenses"),
    ("openrail", "restrictions", r"use based restrictions as referenced in paragraph"),
    ("commons-clause", "sell", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("llama", "llama", r"llama (?:2|3|3 1|3 2|3 3|4) (?:community license|is licensed under)"),
    ("public-domain", "disclaims", r"the author disclaims copyright to this source code"),
    ("public-domain", "claimed", r"no copyright (?:is )?claimed"),
    ("public-domain", "gutenberg", r"project gutenberg license"),
    ("proprietary", "reproduced", r"no part of this (?:document|publication|book|work) may be reproduced"),
    ("proprietary", "secret", r"confidential and trade secret information"),
    ("proprietary", "internal", r"for internal use only"),
    ("proprietary", "eula", r"end user license agreement eula"),
    ("non-commercial", "academic", r"for academic (?:use|purposes) only"),
    ("non-commercial", "educational", r"for educational (?:use|purposes) only"),
    ("non-commercial", "evaluation", r"for evaluation (?:use|purposes) only"),
    ("non-commercial", "personal", r"for personal(?: and)? non ?commercial use(?: only)?"),
    # sentences of grants, conditions and disclaimers
    ("mit", "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", r"merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"),
    ("mit-0", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction [^.]{0,160}? the software is provided as is"),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("0bsd", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "binary", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "consequential", r"direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    ("bsd-3-clause", "contributors", r"neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "developed", r"this product includes software developed by the (?:university of california|organization|author)"),
    ("apache-1", "foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-2", "perpetual", r"perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of"),
    ("apache-2", "notice", r"if the work includes a notice text file as part of its distribution"),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "contribution", r"contribution shall mean any work of authorship including the original version of the work"),
    ("apache-2", "trademarks", r"this license does not grant permission to use the trade names trademarks service marks or product names of the licensor"),
    ("gpl", "useful", r"distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", "freedom", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl-2", "foundation", r"free software foundation inc (?:59 temple place|51 franklin street|675 mass ave)"),
    ("gpl-2", "interactively", r"if the modified program normally reads commands interactively when run you must cause it"),
    ("gpl-3", "convey", r"you may convey verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-3", "corresponding", r"corresponding source for a work in object code form means all the source code needed to generate install"),
    ("gpl-3", "technological", r"no covered work shall be deemed part of an effective technological measure under any applicable law"),
    ("lgpl", "lesser", r"under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "library", r"under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl-2.1", "combine", r"you may also combine or link a work that uses the library with the library to produce a work containing portions of the library"),
    ("lgpl-3", "supplemented", r"incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions"),
    ("agpl-3", "affero", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3", "remotely", r"all users interacting with it remotely through a computer network"),
    ("gfdl-1", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl-1", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2", "incompatible", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("npl", "netscape", r"the contents of this file are subject to the netscape public license"),
    ("epl-1", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v 1 0"),
    ("epl-2", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl-2", "availability", r"secondary licenses when the conditions for such availability set forth in the eclipse public license"),
    ("cpl-1", "common", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl", "ibm", r"the accompanying program is provided under the terms of this ibm public license"),
    ("cddl-1", "distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1", "opensolaris", r"you may not use this file except in compliance with the license you can obtain a copy of the license at usr src opensolaris license"),
    ("spl", "sun", r"the contents of this file are subject to the sun public license"),
    ("apsl", "apple", r"the contents of this file constitute original code as defined in and are subject to the apple public source license"),
    ("eupl-1", "eupl", r"licensed under the eupl (?:version )?1 [012]"),
    ("eupl-1", "european", r"licence means the european union public licence"),
    ("cecill", "cecill", r"this software is governed by the cecill (?:b |c )?licen[cs]e under french law"),
    ("artistic-1", "package", r"you may make and give away verbatim copies of the source form of the standard version of this package"),
    ("artistic-2", "artistic", r"this package is free software you can redistribute it and or modify it under the terms of the artistic license 2 0"),
    ("perl", "perl", r"(?:you can|you may) redistribute it and or modify it under the same terms as perl itself"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "png", r"the png reference library is supplied as is"),
    ("bsl-1", "executable", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("bsl-1", "boost", r"distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "jurisdictions", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"),
    ("wtfpl", "want", r"you just do what the (?:fuck|f) you want to"),
    ("beerware", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("public-domain", "public", r"(?:has been|is|are) (?:hereby )?dedicated to the public domain"),
    ("public-domain", "public", r"(?:has been|is|are|was) (?:hereby )?placed (?:in|into) the public domain"),
    ("public-domain", "government", r"this (?:work|software) was prepared by [^.]{1,60}? of the united states government [^.]{0,80}? public domain"),
    ("blessing", "good", r"may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("postgresql", "postgresql", r"postgresql database management system formerly known as postgres"),
    ("python-2", "psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("python-2", "beopen", r"beopen com hereby grants licensee a non exclusive royalty free world wide license"),
    ("php-3", "php", r"this product includes php software freely available from"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric", r"this product includes cryptographic software written by eric young"),
    ("curl", "stenberg", r"daniel stenberg [^.]{0,120}? permission to use copy modify and distribute"),
    ("ncsa", "illinois", r"university of illinois ncsa open source license"),
    ("llvm-exception", "exception", r"as an exception if as a result of your compiling your source code portions of this software are embedded into an object form"),
    ("icu", "icu", r"icu license icu 1 8 1 and later"),
    ("unicode", "unicode", r"unicode inc license agreement data files and software"),
    ("w3c", "w3c", r"w3c software (?:and document )?notice and license"),
    ("ietf", "ietf", r"subject to bcp 78 and the ietf trust s legal provisions relating to ietf documents"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "reserved", r"no modified version of the font software may use the reserved font name"),
    ("bitstream-vera", "vera", r"the names bitstream and vera must not be used in a renamed font"),
    ("ubuntu-font", "ubuntu", r"ubuntu font licen[cs]e version 1 0"),
    ("gust-font", "gust", r"gust font licen[cs]e"),
    ("lppl", "latex", r"under the conditions of the latex project public license either version 1"),
    ("lppl", "maintenance", r"this work has the lppl maintenance status"),
    ("tcl", "regents", r"this software is copyrighted by the regents of the university of california sun microsystems inc"),
    ("ruby", "copyrighted", r"ruby is copyrighted free software by yukihiro matsumoto"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", r"portions of this software are copyright [^.]{0,40}? the freetype project"),
    ("mit-cmu", "warranties", r"carnegie mellon (?:university )?disclaims all warranties with regard to this software"),
    ("hpnd", "fee", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", "suitability", r"makes no representations about the suitability (?:of )?this software for any purpose it is provided as is"),
    ("ms-pl", "microsoft", r"this license governs use of the accompanying software if you use the software you accept this license [^.]{0,400}? microsoft"),
    ("ms-pl", "patent", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software"),
    ("osl-3", "licensed", r"licensed under the open software license version 3 0"),
    ("afl-3", "academic", r"licensed under the academic free license version 3 0"),
    ("qpl", "q", r"this software may be distributed under the terms of the q public license"),
    ("sleepycat", "redistributions", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("sspl-1", "service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "change", r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("busl-1.1", "production", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("cc0-1", "unconditionally", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("cc0-1", "extent", r"to the extent possible under law [^.]{1,120}? (?:has|have) waived all copyright and related or neighboring rights"),
    ("cc-by", "attribution", r"licensed under a creative commons attribution (?:[1234] [05] )?(?:international|unported|generic) license"),
    ("cc-by-sa", "sharealike", r"licensed under a creative commons attribution sharealike (?:[1234] [05] )?(?:international|unported|generic) license"),
    ("cc-by-nc", "noncommercial", r"licensed under a creative commons attribution noncommercial (?:[1234] [05] )?(?:international|unported|generic) license"),
    ("cc-by-nd", "noderivatives", r"licensed under a creative commons attribution noderivatives (?:[1234] [05] )?(?:international|unported|generic) license"),
    ("cc-by-nc-sa", "sharealike", r"licensed under a creative commons attribution noncommercial sharealike (?:[1234] [05] )?(?:international|unported|generic) license"),
    ("cc-by-nc-nd", "noderivatives", r"licensed under a creative commons attribution noncommercial noderivatives (?:[1234] [05] )?(?:international|unported|generic) license"),
    ("cc-by", "appropriate", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("odbl-1", "database", r"made available under the open database license"),
    ("pddl-1", "dedication", r"made available under the public domain dedication and license"),
    ("odc-by-1", "attribution", r"made available under the open data commons attribution license"),
    ("cdla", "community", r"community data license agreement (?:permissive|sharing) (?:version )?[12] 0"),
    ("ogl-uk", "government", r"contains public sector information licensed under the open government licen[cs]e"),
    ("openrail", "licensed", r"licensed under the (?:creativeml |bigscience )?(?:open )?rail(?: m)? license"),
    ("llama", "llama", r"llama [234](?: [0123456789])? is licensed under the llama [234](?: [0123456789])? community license"),
    ("proprietary", "reserved", r"this software is (?:the )?confidential and proprietary [^.]{0,160}? all rights reserved"),
    ("proprietary", "disclose", r"you shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement"),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "reverse", r"you may not reverse engineer decompile or disassemble the software"),
]


def _split(pattern: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Alternatives outside all groups, and where the outer groups begin and end."""
    depth, bars, opened, groups = 0, [-1], 0, []
    for i, c in enumerate(pattern):
        if c == "(":
            opened = i if depth == 0 else opened
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                groups.append((opened, i + 1))
        elif c == "|" and depth == 0:
            bars.append(i)
    return [pattern[a + 1 : b] for a, b in zip(bars, [*bars[1:], len(pattern)])], groups


def _ways(name: str) -> list[str]:
    """Alternatives of a name, each of which holds the word license always or never."""
    made = []
    for way in _split(name)[0]:
        a, b = next(((a, b) for a, b in _split(way)[1] if "licen" in way[a:b]), (0, 0))
        if a == b:
            made.append(way)
            continue
        optional = way[b : b + 1] == "?"
        for inner in _split(way[a + 3 : b - 1])[0] + [""] * optional:
            made += _ways(way[:a] + inner + way[b + optional :])
    return made


def _bare(name: str) -> str:
    """The name alone where it holds the word license, else with that word behind it. What follows lesser,
    library or affero is the tail of another name."""
    ways = _ways(name)
    forms = [rf"(?:{'|'.join(w for w in ways if 'licen' not in w)}) licen[cs]e"] if any("licen" not in w for w in ways) else []
    if any("licen" in w for w in ways):
        forms.append(rf"(?<!lesser )(?<!library )(?<!affero )(?:{'|'.join(w for w in ways if 'licen' in w)})(?: licen[cs]e)?")
    return rf"(?:the )?(?:{'|'.join(forms)})"


def rules() -> list[Rule]:
    """Four forms of each name (SPDX tag, licence reference, name behind a preposition, bare name with the
    word license in or behind it) and the sentences, in order."""
    made = []
    for label, name, spdx, words in _NAMED:
        for word in words:
            made.append(Rule(f"{label}:spdx:{word}", label, word, rf"spdx license identifier (?:{spdx}|{name})", 90, 0.99))
            made.append(Rule(f"{label}:grant:{word}", label, word, rf"(?:licensed|released|distributed|available|published|provided|covered|governed)(?: (?:to you|as open source|for use|only))? (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? (?:{name})(?: licen[cs]e)?", 80, 0.95))
            made.append(Rule(f"{label}:under:{word}", label, word, rf"(?:under|see|by|with|license|licence)(?: the)? (?:{name})(?: licen[cs]e)?", 60, 0.8))
            made.append(Rule(f"{label}:name:{word}", label, word, _bare(name), 50, 0.7))
    for k, (label, word, pattern) in enumerate(_TEXTS):
        made.append(Rule(f"{label}:text:{k}", label, word, pattern, 85, 0.98))
    return made


class Scanner:
    _SPACED = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

    def __init__(self, own: list[Rule]):
        self.gates: dict[bytes, list] = {}
        for k, r in enumerate(own):
            self.gates.setdefault(r.keyword.encode(), []).append((k, r, re.compile(rf"(?<= )(?:{r.pattern})(?= )".encode())))
        self.base = [(b" " + p.encode() + b" ", p.split()[-1].encode() if p != "apache license version 2" else b"apache", label) for p, label in BASE.items()]

    def scan(self, text: str) -> dict:
        """Words, base places and the detections that stay, all counted in words from 0; ends are exclusive."""
        words = text.encode().lower().translate(self._SPACED).split()  # bytes.lower touches A-Z only
        met = self.gates.keys() & set(words)
        out = {"n_words": len(words), "base": [], "found": [], "score": 0.0}
        if not met:
            return out
        line = b" " + b" ".join(words) + b" "
        spans = []
        for phrase, gate, label in self.base:
            at = line.find(phrase) if gate in met or gate not in self.gates else -1
            while at >= 0:
                spans.append((at, label))
                at = line.find(phrase, at + 1)
        hits = [(m.start(), m.end(), -r.priority, k, r) for word in met for k, r, p in self.gates[word] for m in p.finditer(line)]
        hits.sort(key=lambda h: (h[2], h[0] - h[1], h[0], h[3]))
        kept: list = []  # ascending starts, so ends ascend too
        for h in hits:  # the better ones first
            at = bisect_left(kept, h[0], key=lambda a: a[0])
            inside = any(a[0] <= h[0] and h[1] <= a[1] for a in kept[max(0, at - 1) : at + 1])
            if not inside and not (at < len(kept) and kept[at][1] <= h[1]):
                kept.insert(at, h)
        places = sorted({x for s, _ in spans for x in (s,)} | {h[0] - 1 for h in kept} | {h[1] for h in kept})
        number, seen, before = {}, 0, 0
        for p in places:  # spaces before a place are words before it
            seen += line.count(b" ", before, p)
            number[p], before = seen, p
        out["base"] = sorted((number[s], label) for s, label in spans)
        out["found"] = sorted((number[h[0] - 1], number[h[1]], h[4].label, h[4].name, h[4].priority) for h in kept)
        out["score"] = 1.0 if spans else max([h[4].confidence for h in kept], default=0.0)
        return out


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Append n_words (long), base (array of start and label), detections (array of start, end, label, rule,
    priority; in words, ends exclusive) and score (0 without any, 1 with a base phrase, else the best rule's
    confidence) to every row.

    Null counts as empty: no words, empty arrays, score 0. Whole texts are scanned; other columns pass
    through and those with these names are replaced.
    """
    own = rules()

    def start():
        scanner = Scanner(own)

        def step(texts: list) -> list[pa.Array]:
            made = [scanner.scan(t or "") for t in texts]
            base = [[{"start": s, "label": x} for s, x in m["base"]] for m in made]
            found = [[{"start": s, "end": e, "label": x, "rule": r, "priority": p} for s, e, x, r, p in m["found"]] for m in made]
            return [
                pa.array([m["n_words"] for m in made], type=pa.int64()),
                pa.array(base, type=pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
                pa.array(found, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32())]))),
                pa.array([m["score"] for m in made], type=pa.float64()),
            ]

        return step

    schema = T._parse_datatype_string("n_words bigint, base array<struct<start:bigint,label:string>>, detections array<struct<start:bigint,end:bigint,label:string,rule:string,priority:int>>, score double")
    return append_columns(docs, text_col, schema.fields, start)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document: ``scan_licenses``
    in figures. Null and empty texts have no word and empty labels; repeated rows get equal results."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    joined = lambda a: F.concat_ws(",", F.sort_array(F.array_distinct(a)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.array_union("base.label", "detections.label")).alias("labels"),
        "score",
    )
