r"""Operator 10: license scans by ordered signature rules, in native expressions only.

A rule is a regular expression with a label, a priority and a score, and keywords. Runs of white space, and the
marks that begin the lines of comments, first become one blank, so that a notice may be wrapped anywhere.
A text is searched for the literals that matches must contain, and a rule is tried only in the surroundings
of such a literal that hold one of its own and one of its keywords. The surroundings reach as far as the longest
possible match of any rule, so none is cut. Most texts meet no rule at all. All detections of a text
are sorted by place; one that lies inside another of better priority is suppressed ("GPL" inside "GNU
Affero General Public License, version 3 (AGPL)", "license: MIT" inside an SPDX line). The labels of
what is left, and of the base phrases, are the text's labels.

Rules are of two sorts: signatures written one by one (passages of license texts, notices, exceptions, dual
licenses, warranty and copyright lines, addresses), and the product of license names and ways of granting a
license. Everything happens inside a row: no shuffle, no join, no group.

Defined results: a null text counts as empty (no words, no places, empty label strings, score 0); equal
texts give equal values; a null doc_id stays; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.native import let, piece, spans, text_blocks

#: A word character once A-Z are lower-cased, and what stands between words.
WORD = r"[\p{Alnum}[^\x00-\x7F]]"
GAP = r"[\x00-\x7F&&[^\p{Alnum}]]+"

#: Base phrases and their labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, name as a regular expression, keywords of which any such name contains one.
NAMES = (
    ("mit", r"(?:the )?(?:mit|expat)(?:[ /]x11)?", "mit|expat"),
    ("mit-0", r"mit no attribution|mit-0", "mit"),
    ("x11", r"(?:the )?x11", "x11"),
    ("isc", r"(?:the )?isc|internet (?:systems|software) consortium", "isc|internet"),
    ("apache-2", r"(?:the )?apache(?: software)?(?: license)?,?[ -]?(?:version |v)?2(?:\.0)?", "apache"),
    ("apache-1.1", r"(?:the )?apache(?: software)?(?: license)?,?[ -]?(?:version |v)?1\.1", "apache"),
    ("bsd", r"(?:the )?bsd", "bsd"),
    ("bsd-2-clause", r"(?:the )?(?:bsd[ -]2[ -]clause|2[ -]clause bsd|simplified bsd|freebsd)", "bsd"),
    ("bsd-3-clause", r"(?:the )?(?:bsd[ -]3[ -]clause|3[ -]clause bsd|(?:new|revised|modified) bsd)", "bsd"),
    ("bsd-4-clause", r"(?:the )?(?:bsd[ -]4[ -]clause|4[ -]clause bsd|original bsd)", "bsd"),
    ("0bsd", r"(?:the )?(?:zero[ -]clause bsd|0bsd|bsd[ -]zero[ -]clause)", "bsd"),
    ("gpl", r"(?:the )?(?:gnu )?(?:general public|gpl)", "general|gpl"),
    ("gpl-1", r"(?:the )?(?:gnu )?(?:general public license|gpl),?[ -]?(?:version |v)?1(?:\.0)?", "general|gpl"),
    ("gpl-2", r"(?:the )?(?:gnu )?(?:general public license|gpl),?[ -]?(?:version |v)?2(?:\.0)?", "general|gpl"),
    ("gpl-3", r"(?:the )?(?:gnu )?(?:general public license|gpl),?[ -]?(?:version |v)?3(?:\.0)?", "general|gpl"),
    ("lgpl", r"(?:the )?(?:gnu )?(?:(?:lesser|library) general public|lgpl)", "lesser|library|lgpl"),
    ("lgpl-2", r"(?:the )?(?:gnu )?(?:(?:lesser|library) general public license|lgpl),?[ -]?(?:version |v)?2(?:\.0)?(?!\.1)", "lesser|library|lgpl"),
    ("lgpl-2.1", r"(?:the )?(?:gnu )?(?:(?:lesser|library) general public license|lgpl),?[ -]?(?:version |v)?2\.1", "lesser|library|lgpl"),
    ("lgpl-3", r"(?:the )?(?:gnu )?(?:lesser general public license|lgpl),?[ -]?(?:version |v)?3(?:\.0)?", "lesser|lgpl"),
    ("agpl-3", r"(?:the )?(?:gnu )?(?:affero general public license|agpl),?[ -]?(?:version |v)?3(?:\.0)?", "affero|agpl"),
    ("gfdl", r"(?:the )?(?:gnu )?(?:free documentation|gfdl|fdl)", "documentation|fdl"),
    ("mpl-1.1", r"(?:the )?(?:mozilla public license|mpl),?[ -]?(?:version |v)?1\.1", "mozilla|mpl"),
    ("mpl-2", r"(?:the )?(?:mozilla public license|mpl),?[ -]?(?:version |v)?2(?:\.0)?", "mozilla|mpl"),
    ("epl-1", r"(?:the )?(?:eclipse public license|epl),?[ -]?(?:version |v)?1(?:\.0)?", "eclipse|epl"),
    ("epl-2", r"(?:the )?(?:eclipse public license|epl),?[ -]?(?:version |v)?2(?:\.0)?", "eclipse|epl"),
    ("edl", r"(?:the )?eclipse distribution", "eclipse"),
    ("cddl", r"(?:the )?(?:common development and distribution|cddl)", "cddl|distribution"),
    ("cpl", r"(?:the )?common public", "common"),
    ("ipl", r"(?:the )?ibm public", "ibm"),
    ("eupl", r"(?:the )?(?:european union public|eupl)", "eupl|european"),
    ("artistic-1", r"(?:the )?artistic license,?[ -]?(?:version |v)?1(?:\.0)?", "artistic"),
    ("artistic-2", r"(?:the )?artistic license,?[ -]?(?:version |v)?2(?:\.0)?", "artistic"),
    ("psf", r"(?:the )?(?:python software foundation|psf)", "psf|python"),
    ("php", r"(?:the )?php", "php"),
    ("ruby", r"(?:the )?ruby", "ruby"),
    ("perl", r"(?:the same terms as )?perl", "perl"),
    ("zlib", r"(?:the )?zlib(?:/libpng)?", "zlib"),
    ("libpng", r"(?:the )?libpng", "libpng"),
    ("bsl-1", r"(?:the )?boost(?: software)?", "boost"),
    ("busl-1.1", r"(?:the )?(?:business source|busl)", "business|busl"),
    ("sspl", r"(?:the )?(?:server side public|sspl)", "sspl|server"),
    ("elastic-2", r"(?:the )?elastic", "elastic"),
    ("wtfpl", r"(?:the )?(?:wtfpl|do what the fuck you want to public)", "wtfpl|fuck"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("cc0", r"(?:the )?(?:cc0|creative commons zero)(?: 1\.0)?", "cc0|creative"),
    ("cc-by", r"(?:the )?(?:cc[ -]by|creative commons attribution)(?![ -](?:nc|sa|nd|non|share|no ))(?:[ -][1-4]\.0)?", "cc|creative"),
    ("cc-by-sa", r"(?:the )?(?:cc[ -]by[ -]sa|creative commons attribution[ -]share[ -]?alike)(?:[ -][1-4]\.0)?", "cc|creative"),
    ("cc-by-nd", r"(?:the )?(?:cc[ -]by[ -]nd|creative commons attribution[ -]no[ -]?deriv(?:s|atives?|ative works)?)(?:[ -][1-4]\.0)?", "cc|creative"),
    ("cc-by-nc", r"(?:the )?(?:cc[ -]by[ -]nc|creative commons attribution[ -]non[ -]?commercial)(?![ -](?:sa|nd|share|no))(?:[ -][1-4]\.0)?", "cc|creative"),
    ("cc-by-nc-sa", r"(?:the )?(?:cc[ -]by[ -]nc[ -]sa|creative commons attribution[ -]non[ -]?commercial[ -]share[ -]?alike)(?:[ -][1-4]\.0)?", "cc|creative"),
    ("cc-by-nc-nd", r"(?:the )?(?:cc[ -]by[ -]nc[ -]nd|creative commons attribution[ -]non[ -]?commercial[ -]no[ -]?deriv(?:s|atives?|ative works)?)(?:[ -][1-4]\.0)?", "cc|creative"),
    ("odbl", r"(?:the )?(?:open (?:data commons )?(?:open )?database|odbl)", "odbl|database"),
    ("pddl", r"(?:the )?(?:public domain dedication and|pddl)", "pddl|dedication"),
    ("ofl-1.1", r"(?:the )?(?:sil )?open font", "font"),
    ("openssl", r"(?:the )?openssl", "openssl"),
    ("osl-3", r"(?:the )?open software", "software"),
    ("afl-3", r"(?:the )?academic free", "academic"),
    ("ms-pl", r"(?:the )?microsoft public|ms-pl", "ms-pl|microsoft"),
    ("ms-rl", r"(?:the )?microsoft reciprocal|ms-rl", "ms-rl|microsoft"),
    ("ncsa", r"(?:the )?(?:university of illinois/)?ncsa", "ncsa"),
    ("upl-1", r"(?:the )?universal permissive", "universal"),
    ("w3c", r"(?:the )?w3c", "w3c"),
    ("beerware", r"(?:the )?beer-?ware", "beer"),
    ("proprietary", r"(?:a |our )?(?:proprietary|commercial)", "proprietary|commercial"),
)

#: How a license is granted: an expression with {} for the license's name, literals of which any match contains one,
#: priority, score.
WAYS = (
    (r"spdx-license-identifier: ?(?:{})(?:[ -]license)?\b", "spdx", 1, 1.0),
    (r"\b(?:re)?(?:licensed|released|distributed|published|available|provided|issued) under (?:the terms of )?(?:{})(?:[ -]licen[sc]e)?(?!\w)", "ed under|le under", 2, 0.95),
    (r"(?<!\w)(?:{})(?:[ -]licen[sc]e)(?!\w)", "licen", 3, 0.8),
    (r"\blicen[sc]e[\"']? ?[:=] ?[\"']?(?:{})(?:[ -]licen[sc]e)?(?!\w)", "licen", 4, 0.7),
    (r"\b(?:subject to|governed by|covered by|under the terms of) (?:{})(?:[ -]licen[sc]e)?(?!\w)", "subject to|governed by|covered by|under the terms of", 5, 0.6),
)

#: Signatures of license texts, notices, exceptions and addresses, one a line: label, expression, literals of which any
#: match contains one (by commas), priority, score. The bar inside an expression is written as it is.
SIGNATURES = r"""
mit|permission is hereby granted, free of charge, to any person obtaining a copy|hereby|2|0.95
mit|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software|permission|3|0.85
mit|to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies|sublicense|3|0.85
mit|the software is provided ["']as is["'], without warranty of any kind|without warranty of any kind|5|0.5
mit|in no event shall the authors or copyright holders be liable for any claim, damages or other liability|liable|5|0.5
mit|opensource\.org/licenses/mit\b|opensource.org|2|0.9
mit|choosealicense\.com/licenses/mit\b|choosealicense|2|0.9
mit-0|and to permit persons to whom the software is furnished to do so\. the software is provided|furnished|1|0.9
isc|permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted|hereby|2|0.95
isc|provided that the above copyright notice and this permission notice appear in all copies|permission|3|0.8
isc|the author disclaims all warranties with regard to this software|disclaims|4|0.6
0bsd|permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software|hereby|1|0.95
bsd|redistribution and use in source and binary forms, with or without modification, are permitted|redistribution|3|0.85
bsd|redistribution and use in source and binary forms|redistribution|4|0.8
bsd|redistributions of source code must retain the above copyright notice|redistributions|4|0.8
bsd|redistributions in binary form must reproduce the above copyright notice|redistributions|4|0.8
bsd-3-clause|neither the names? of .{1,60}? nor the names of (?:its|their|the) (?:contributors|copyright holders?) may be used to endorse or promote products|endorse|2|0.9
bsd-3-clause|may be used to endorse or promote products derived from this software without specific prior written permission|endorse|3|0.85
bsd-4-clause|all advertising materials mentioning features or use of this software must display the following acknowledge?ment|advertising|2|0.9
bsd-2-clause-patent|bsd[ -]2[ -]clause plus patent|plus patent|2|0.9
bsd-3-clause-clear|no express or implied licenses to any party's patent rights are granted by this license|patent|2|0.9
bsd|use of this source code is governed by a bsd-style licen[sc]e|bsd-style|2|0.9
bsd|opensource\.org/licenses/bsd-[23]-clause\b|opensource.org|2|0.9
apache-2|licensed under the apache license, version 2\.0 \(the ["']license["']\)|apache|1|1.0
apache-2|you may not use this file except in compliance with the license|compliance|3|0.85
apache-2|unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an ["']as is["'] basis|applicable law|3|0.85
apache-2|apache\.org/licenses/license-2\.0\b|apache.org|2|0.9
apache-2|licensed to the apache software foundation \(asf\) under one or more contributor license agreements|apache|2|0.95
apache-2|apache license,? version 2\.0, january 2004|apache|1|1.0
apache-2|perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|\(except as stated in this section\) patent) license|perpetual|3|0.9
apache-1.1|this product includes software developed by the apache software foundation|apache|2|0.9
apache-2-llvm|apache license v2\.0 with llvm exceptions|llvm|1|1.0
gpl|this program is free software[:;] you can redistribute it|redistribute|3|0.85
gpl|gnu\.org/licenses/(?:old-licenses/)?gpl\b|gnu.org|2|0.9
gpl|gnu general public license for more details|for more details|4|0.7
gpl|you should have received a copy of the gnu general public license along with|you should have received|3|0.85
gpl-1-plus|either version 1 of the license, or \(at your option\) any later version|either version|2|0.9
gpl-2-plus|gnu general public license as published by the free software foundation[;,] either version 2(?: of the license)?, or \(at your option\) any later version|general public license as published|1|1.0
gpl-3-plus|gnu general public license as published by the free software foundation[;,] either version 3(?: of the license)?, or \(at your option\) any later version|general public license as published|1|1.0
gpl-2-only|gnu general public license as published by the free software foundation[;,] version 2(?: of the license)?(?:\.|,? only)|general public license as published|1|1.0
gpl-3-only|gnu general public license as published by the free software foundation[;,] version 3(?: of the license)?(?:\.|,? only)|general public license as published|1|1.0
gpl-2|gnu general public license,? version 2, june 1991|june 1991|1|1.0
gpl-3|gnu general public license,? version 3, 29 june 2007|june 2007|1|1.0
gpl-2-plus|\bgplv?-?2(?:\.0)?(?:\+|-or-later| or later)|gpl|2|0.9
gpl-3-plus|\bgplv?-?3(?:\.0)?(?:\+|-or-later| or later)|gpl|2|0.9
gpl-2-only|\bgplv?-?2(?:\.0)?[ -]only|gpl|2|0.9
gpl-3-only|\bgplv?-?3(?:\.0)?[ -]only|gpl|2|0.9
gpl-classpath-exception|linking this library statically or dynamically with other modules is making a combined work based on this library|linking|2|0.9
gpl-classpath-exception|\bclasspath[ -]exception|classpath|2|0.9
gpl-gcc-exception|gcc runtime library exception|gcc|2|0.9
gpl-autoconf-exception|configuration script generated by autoconf, you may include it under the same distribution terms|autoconf|2|0.9
gpl-bison-exception|you may create a larger work that contains part or all of the bison parser skeleton|bison|2|0.9
gpl-font-exception|this font does not by itself cause the resulting document to be covered by the gnu general public license|this font does|2|0.9
gpl-linking-exception|as a special exception, the copyright holders? (?:of .{1,80}? )?gives? (?:you )?permission to link|special exception|2|0.9
linux-syscall-note|does \*?not\*? cover user programs that use kernel services by normal system calls|system calls|2|0.9
lgpl-2.1-plus|gnu lesser general public license as published by the free software foundation[;,] either version 2\.1(?: of the license)?, or \(at your option\) any later version|lesser general|1|1.0
lgpl-3-plus|gnu lesser general public license as published by the free software foundation[;,] either version 3(?: of the license)?, or \(at your option\) any later version|lesser general|1|1.0
lgpl-2-plus|gnu library general public license as published by the free software foundation[;,] either version 2(?: of the license)?, or \(at your option\) any later version|library general|1|1.0
lgpl|gnu\.org/(?:licenses|copyleft)/lgpl\b|gnu.org|2|0.9
lgpl|gnu (?:lesser|library) general public license for more details|for more details|3|0.75
lgpl-2.1-plus|\blgplv?-?2\.1(?:\+|-or-later| or later)|lgpl|2|0.9
lgpl-3-plus|\blgplv?-?3(?:\.0)?(?:\+|-or-later| or later)|lgpl|2|0.9
agpl-3-plus|gnu affero general public license as published by the free software foundation[;,] either version 3(?: of the license)?, or \(at your option\) any later version|affero general|1|1.0
agpl-3|gnu\.org/licenses/agpl\b|gnu.org|2|0.9
agpl-3|remote network interaction; use with the gnu general public license|remote network|2|0.9
agpl-3-plus|\bagplv?-?3(?:\.0)?(?:\+|-or-later| or later)|agpl|2|0.9
gfdl|permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license|free documentation|1|1.0
gfdl|with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts|invariant|2|0.9
mpl-2|this source code form is subject to the terms of the mozilla public license, v\. ?2\.0|mozilla|1|1.0
mpl-2|if a copy of the mpl was not distributed with this file, you can obtain one at|mpl|2|0.9
mpl-2|mozilla\.org/mpl/2\.0\b|mozilla.org|2|0.9
mpl-1.1|the contents of this file are subject to the mozilla public license version 1\.1|mozilla|1|1.0
mpl-2-no-copyleft|this source code form is ["']incompatible with secondary licenses["']|secondary|1|0.95
mpl-gpl-lgpl|may be used under the terms of either the gnu general public license version 2 or later|either the gnu|1|0.95
epl-1|eclipse\.org/legal/epl-v10\b|eclipse.org|2|0.9
epl-2|eclipse\.org/legal/epl-(?:2\.0|v20)\b|eclipse.org|2|0.9
epl-2|this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version )?2\.0|accompanying|1|1.0
epl-1|this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version )?1\.0|accompanying|1|1.0
edl|eclipse\.org/org/documents/edl-v10\b|eclipse.org|2|0.9
cddl|subject to the terms of (?:either the gnu general public license version 2 only .{1,12}? or )?the common development and distribution license|common development|1|1.0
cpl|opensource\.org/licenses/cpl1\.0|opensource.org|2|0.9
eupl|joinup\.ec\.europa\.eu/(?:collection/eupl|software/page/eupl)|joinup|2|0.9
eupl|licensed under the eupl(?:,? (?:v|version )?1\.[012])?|eupl|2|0.9
cecill|\bcecill(?:-[bc])?(?: version)? ?(?:2(?:\.[01])?)?\b|cecill|3|0.8
artistic-2|everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed\. preamble this license establishes the terms under which a given free software package|verbatim|2|0.8
perl|you can redistribute it and/or modify it under the same terms as perl itself|perl|1|0.95
python|python software foundation license version 2|python software|1|0.95
php|this product includes php software, freely available from|php|2|0.9
ruby|you may redistribute it and/or modify it under either the terms of the (?:2-clause bsdl|gpl)|redistribute|2|0.85
zlib|this software is provided ['"]as-is['"], without any express or implied warranty|as-is|2|0.9
zlib|the origin of this software must not be misrepresented; you must not claim that you wrote the original software|misrepresented|2|0.95
zlib|altered source versions must be plainly marked as such|altered|3|0.85
bsl-1|boost\.org/license_1_0\.txt|boost.org|2|0.95
bsl-1|distributed under the boost software license, version 1\.0|boost|1|1.0
busl-1.1|the business source license \(this document, or the ["']license["']\) is not an open source license|business|1|0.95
busl-1.1|\bchange license: |change license|3|0.7
sspl|offering the program as a service, which includes|as a service|3|0.7
sspl|server side public license,? version 1, october 16, 2018|server side|1|1.0
elastic-2|you may not provide the software to third parties as a hosted or managed service|hosted or managed|2|0.9
commons-clause|["']?commons clause["']? license condition|commons clause|2|0.95
commons-clause|the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software|right to sell|2|0.9
polyform|polyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use) license|polyform|2|0.95
wtfpl|you just do what the fuck you want to|fuck|2|0.95
unlicense|this is free and unencumbered software released into the public domain|unencumbered|1|1.0
unlicense|anyone is free to copy, modify, publish, use, compile, sell, or distribute this software|compile|2|0.9
unlicense|\bunlicense\.org\b|unlicense.org|2|0.9
cc0|creativecommons\.org/publicdomain/zero/|creativecommons|2|0.9
cc0|to the extent possible under law, .{1,60}? (?:has|have) waived all copyright|waived|2|0.95
cc-pdm|creativecommons\.org/publicdomain/mark/|creativecommons|2|0.9
cc-by|creativecommons\.org/licenses/by/|creativecommons|2|0.9
cc-by-sa|creativecommons\.org/licenses/by-sa/|creativecommons|2|0.9
cc-by-nd|creativecommons\.org/licenses/by-nd/|creativecommons|2|0.9
cc-by-nc|creativecommons\.org/licenses/by-nc/|creativecommons|2|0.9
cc-by-nc-sa|creativecommons\.org/licenses/by-nc-sa/|creativecommons|2|0.9
cc-by-nc-nd|creativecommons\.org/licenses/by-nc-nd/|creativecommons|2|0.9
odbl|opendatacommons\.org/licenses/odbl\b|opendatacommons|2|0.9
pddl|opendatacommons\.org/licenses/pddl\b|opendatacommons|2|0.9
odc-by|opendatacommons\.org/licenses/by\b|opendatacommons|2|0.9
ogl-uk|contains public sector information licensed under the open government licen[cs]e(?: v[123]\.0)?|open government|2|0.95
ogl-uk|open government licen[cs]e(?: v[123]\.0)?|open government|3|0.8
etalab|licence ouverte(?: / open licence)?|licence ouverte|3|0.8
dl-de-by|datenlizenz deutschland [-–] namensnennung|datenlizenz|2|0.9
dl-de-zero|datenlizenz deutschland [-–] zero|datenlizenz|2|0.9
cdla-permissive|community data license agreement [-–] permissive|community data|2|0.95
cdla-sharing|community data license agreement [-–] sharing|community data|2|0.95
ofl-1.1|scripts\.sil\.org/ofl\b|sil.org|2|0.9
ofl-1.1|this font software is licensed under the sil open font license|sil open font|1|1.0
openssl|this product includes software developed by the openssl project|openssl|2|0.9
ssleay|this product includes cryptographic software written by eric young|cryptographic|2|0.9
curl|fitness for a particular purpose and noninfringement of third party rights|third party|1|0.9
ncsa|redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers\.|disclaimers|2|0.85
postgresql|for any purpose, without fee, and without a written agreement is hereby granted|written agreement|2|0.95
tcl|the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose|hereby|2|0.95
upl-1|subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data|hereby|2|0.95
w3c|w3\.org/consortium/legal/(?:20\d\d/)?copyright-software\b|w3.org|2|0.9
ijg|this software is based in part on the work of the independent jpeg group|jpeg|2|0.95
freetype|portions of this software are copyright .{1,40}? the freetype project|freetype|2|0.95
beerware|you can buy me a beer in return|a beer|2|0.95
json|the software shall be used for good, not evil|not evil|1|1.0
unicode|unicode,? inc\.? license agreement [-–] data files and software|unicode|2|0.95
ms-eula|microsoft software license terms|microsoft|2|0.9
apple-sample|apple grants you a personal, non-exclusive license|apple|2|0.85
nvidia|this source code and/or documentation \(["']licensed deliverables["']\) are subject to nvidia intellectual property rights|nvidia|2|0.9
llama|llama (?:2|3|3\.1|3\.2|3\.3) community license(?: agreement)?|llama|2|0.95
openrail|(?:creativeml|bigscience|bigcode) open ?rail(?:[ +-]m)?(?: license)?|openrail,open rail|2|0.95
gemma|gemma terms of use|gemma|2|0.9
dual-mit-apache|licensed under either of (?:the )?apache license,? version 2\.0 .{0,60}? ?or (?:the )?mit license|either of|1|1.0
dual-mit-apache|\b(?:mit (?:or|/) ?apache-2\.0|apache-2\.0 (?:or|/) ?mit)\b|apache|2|0.95
dual-mit-gpl|dual(?:-| )licensed under (?:the )?mit (?:and|or) gpl|dual|1|0.95
dual-bsd-gpl|\bdual bsd/gpl\b|dual|1|0.95
dual|\bdual[ -]licensed under\b|dual|4|0.6
public-domain|\b(?:is|are|placed|released|dedicated)(?: in| into| to)? the public domain\b|the public domain|4|0.6
public-domain|no copyright is claimed (?:in|and)|no copyright|4|0.6
us-government-work|a work of the (?:u\.?s\.?|united states) government|s government,s. government|3|0.7
all-rights-reserved|\ball rights reserved\b|all rights reserved|6|0.3
proprietary|this (?:software|document|source code) is (?:the )?(?:confidential and proprietary|proprietary and confidential)|proprietary|2|0.9
proprietary|unauthorized (?:copying|reproduction|distribution|use)(?: or (?:copying|distribution|use|disclosure))? of this (?:file|software|document|work)[^.]{0,60}is (?:strictly )?prohibited|unauthorized|2|0.9
proprietary|this (?:software|work) may not be (?:copied|reproduced|redistributed)[^.]{0,60}without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)|may not be|3|0.8
non-commercial|for (?:non-?commercial|academic|research|educational|personal)(?:,? (?:and|or) (?:non-?commercial|academic|research|educational|personal))? (?:use|purposes) only|use only,purposes only|4|0.6
evaluation|for (?:evaluation|trial|testing) (?:use|purposes) only|use only,purposes only|4|0.6
no-ai-training|may not be used (?:to train|for (?:the )?training(?: of)?) (?:an? )?(?:ai|artificial intelligence|machine learning|large language) (?:models?|systems?)|may not be used|2|0.9
warranty-disclaimer|without even the implied warranty of merchantability or fitness for a particular purpose|merchantability|6|0.3
copyright|(?:\bcopyright|\(c\)|©) ?(?:\(c\)|©)? ?(?:19|20)\d\d(?: ?[-–,] ?(?:19|20)?\d\d){0,12}|copyright,(c),©|7|0.1
"""

#: White space, and the marks that begin the lines of comments.
BREAKS = r"\s++(?:(?:[#*;%]++|//++)\s++)*+"


def normal(text: Column) -> Column:
    """The lower-case text with every run of white space, line marks included, as one blank."""
    return F.regexp_replace(F.lower(text), F.lit(BREAKS), F.lit(" "))


#: Literals that many signatures share. One that a signature must hold takes the place of its own, so that there are fewer.
ROOTS = ("licen", "copyright", "permi", "distribut", "warrant", "gnu", "creativecommons", "opendatacommons", "proprietary", "software", "general public")


def _must_hold(expression: str) -> str | None:
    """The first of ROOTS that stands in an expression outside all groups, classes and optional characters."""
    plain, old = expression, None
    while plain != old:
        plain, old = re.sub(r"\((?:[^()\\]|\\.)*\)(?:[?*]|\{\d+,\d+\}\??)?", "\n", plain), plain
    plain = re.sub(r"\[[^]]*\](?:\?|\{\d+,\d+\}\??)?|[^\\]\?|\.\{\d+,\d+\}\??", "\n", plain)
    return next((root for root in ROOTS if root in plain), None)


def signatures() -> list[tuple[str, str, list[str], int, float]]:
    """The signatures as (label, expression, literals, priority, score)."""
    made = []
    for line in SIGNATURES.strip().splitlines():
        label, _, rest = line.partition("|")
        expression, literals, priority, score = rest.rsplit("|", 3)
        shared = _must_hold(expression)
        made.append((label, expression, [shared] if shared else literals.split(","), int(priority), float(score)))
    return made


def longest(expression: str) -> int:
    """The length of the longest possible match of an expression; an unbounded one is an error."""
    low, high = re._parser.parse(expression).getwidth()
    if high >= 10_000:
        raise ValueError(f"matches of any length: {expression}")
    return high


def rules() -> list[dict]:
    """Every rule, in order of priority. A match contains one of its ``gates`` and one of its ``keys``."""
    made = [
        {"p": priority, "score": score, "label": label, "gates": gates.split("|"), "keys": keys.split("|"), "re": way.format(name)}
        for way, gates, priority, score in WAYS
        for label, name, keys in NAMES
    ]
    made += [{"p": p, "score": score, "label": label, "gates": keys, "keys": keys, "re": r} for label, r, keys, p, score in signatures()]
    return [rule | {"n": n} for n, rule in enumerate(sorted(made, key=lambda r: r["p"]))]


def reach() -> int:
    """How far a match can reach from a literal inside it, with a character of its surroundings and an overlapping literal."""
    return max(longest(rule["re"]) for rule in rules()) + max(map(len, _literals())) + 1


def _literals() -> list[str]:
    found = {gate for rule in rules() for gate in rule["gates"]}
    return sorted(x for x in found if not any(y in x for y in found - {x}))


def _holds_literal(text: Column) -> Column:
    """Does a normalised text hold any rule's literal?"""
    found = F.lit(False)
    for literal in _literals():
        found = found | F.contains(text, F.lit(literal))
    return found


def _windows(text: Column) -> Column:
    """Places (s, e) around the rules' literals, merged where they meet."""
    far = reach()
    anchor = F.lit("|".join(re.escape(x) for x in _literals()))

    def merged(around: Column) -> Column:
        # A place begins a window if it does not meet the one before it; the window ends where the last of its places does.
        begins = F.filter(around, lambda x, i: (i == 0) | (x["s"] > around[i - 1]["e"]))
        ends = F.filter(around, lambda x, i: (i == F.size(around) - 1) | (around[i + 1]["s"] > x["e"]))
        return F.zip_with(begins, ends, lambda b, e: F.struct(b["s"].alias("s"), e["e"].alias("e")))

    return let(F.transform(spans(text, anchor), lambda x: F.struct(F.greatest(x["s"] - far, F.lit(0)).alias("s"), (x["e"] + far).alias("e"))), merged)


def base_pattern() -> str:
    phrases = "|".join(GAP.join(phrase.split()) for phrase, _ in BASE)
    return f"(?i)(?<!{WORD})(?:{phrases})(?!{WORD})"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+"))


_RULE = "array<struct<p:int,score:double,label:string,gates:array<string>,keys:array<string>,re:string,n:int>>"


def detections(text: Column) -> Column:
    """Labels and best score of the rules' detections in a text, after suppression: struct(labels, score); null if it holds no literal."""

    def gated(t: Column) -> Column:
        return F.when(_holds_literal(t), let(text_blocks(t), lambda blocks: _detected(t, blocks)))

    return let(normal(text), gated)


def _detected(text: Column, blocks: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(rules())), _RULE)

    def in_window(w: Column) -> Column:
        return let(piece(blocks, w["s"], F.least(w["e"], F.length(text))), lambda part: in_part(w, part))

    def in_part(w: Column, part: Column) -> Column:
        has = lambda words: F.exists(words, lambda k: F.contains(part, k))
        tried = F.filter(table, lambda r: has(r["gates"]) & has(r["keys"]))
        return F.flatten(
            F.transform(
                tried,
                lambda r: F.transform(
                    spans(part, r["re"]),
                    lambda x: F.struct((x["s"] + w["s"]).alias("s"), (-x["e"] - w["s"]).alias("e"), r["p"].alias("p"), r["n"].alias("n"), r["score"].alias("score"), r["label"].alias("label")),
                ),
            )
        )

    hits = F.flatten(F.transform(_windows(text), in_window))

    def step(state: Column, x: Column) -> Column:
        # e is kept negative, so that of two hits with one start the longer comes first.
        around = F.filter(state["open"], lambda o: o["e"] > x["s"])
        inside = F.exists(around, lambda o: (o["e"] >= -x["e"]) & ((o["p"] < x["p"]) | ((o["p"] == x["p"]) & ((o["s"] < x["s"]) | (o["e"] > -x["e"]) | (o["n"] < x["n"])))))
        opened = F.array_append(around, F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["p"].alias("p"), x["n"].alias("n")))
        return F.struct(
            opened.alias("open"),
            F.when(inside, state["labels"]).otherwise(F.array_union(state["labels"], F.array(x["label"]))).alias("labels"),
            F.when(inside, state["score"]).otherwise(F.greatest(state["score"], x["score"])).alias("score"),
        )

    zero = F.struct(
        F.array().cast("array<struct<s:int,e:int,p:int,n:int>>").alias("open"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score")
    )
    return F.aggregate(F.array_sort(hits), zero, step, lambda s: F.struct(s["labels"].alias("labels"), s["score"].alias("score")))


def license_scan(docs: DataFrame) -> DataFrame:
    """Base places and labels of every text of ``docs`` (doc_id, text)."""
    plain = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text, low = F.col("text"), F.lower(F.col("text"))
    pattern = F.lit(base_pattern())
    gated = plain.select(
        "doc_id",
        n_words(text).cast("long").alias("n_words"),
        F.when(F.contains(low, F.lit("license")) | (F.contains(low, F.lit("cc")) & F.contains(low, F.lit("nc"))), F.regexp_extract_all(text, pattern, F.lit(0))).alias("found"),
        detections(text).alias("hits"),
        "text",
    )
    n_base = F.coalesce(F.size("found"), F.lit(0))
    between = F.split(text, pattern, -1)
    placed = gated.select(
        "doc_id",
        "n_words",
        F.when(F.col("found").isNull(), 0).otherwise(n_base).cast("long").alias("n_base"),
        F.when(F.size("found") > 0, n_words(between[0])).cast("long").alias("first_word"),
        F.when(F.size("found") > 0, F.col("n_words") - n_words(F.element_at(between, -1)) - n_words(F.element_at(F.col("found"), -1))).cast("long").alias("last_word"),
        F.coalesce(
            F.array_distinct(
                F.transform(
                    F.col("found"),
                    lambda x: F.when(F.lower(x).startswith("under"), F.lit(BASE[0][1])).when(F.lower(x).startswith("apache"), F.lit(BASE[1][1])).otherwise(F.lit(BASE[2][1])),
                )
            ),
            F.array().cast("array<string>"),
        ).alias("base"),
        "hits",
    )
    label_list = F.array_sort(F.array_union(F.col("base"), F.coalesce(F.col("hits")["labels"], F.array().cast("array<string>"))))
    return placed.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(label_list, ",").alias("labels"),
        F.greatest(F.coalesce(F.col("hits")["score"], F.lit(0.0)), F.when(F.col("n_base") > 0, 0.9).otherwise(0.0)).alias("score"),
    )
