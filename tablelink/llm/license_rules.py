"""Hand-written signatures of license texts, over words: lower-cased A-Z, one space
between words, signs dropped.

Each is a label, a priority (smaller is stronger), a score, a keyword that stands in
every match and a regular expression. A label of None marks a place that says a license
is not given; it takes the places inside of it along and gives no label itself.
"""

from __future__ import annotations

# Up to some words in between, as few as fit.
_SOME = r"(?:[^ ]+ ){0,12}?"
# What a license can be called in a sentence that denies it.
_ANY = (
    r"(?:(?:terms|conditions) of )?(?:the |an? |any )?(?:(?:[^ ]+ ){0,5}?licen[cs]es?"
    r"|(?:gnu )?[al]?gpl(?: ?v?[123])?|mpl|cddl|wtfpl|cc0|cc by(?: (?:nc|sa|nd))*|public domain)"
)

# Sentences that a license's own text begins with or is known by.
BODIES = (
    ("mit", 1, 1.0, "obtaining a copy", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 2, 0.95, "deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", 3, 0.9, "this permission notice", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit-0", 1, 1.0, "to permit persons", r"sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", 2, 0.95, "x consortium", r"the name of the x consortium shall not be used in advertising"),
    ("isc", 1, 1.0, "with or without fee", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", 1, 1.0, "with or without fee", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", 2, 0.95, "and its documentation", r"permission to use copy modify (?:and )?(?:distribute )?(?:and )?(?:sell )?this software and its documentation for any purpose"),
    ("bsd", 1, 1.0, "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", 2, 0.95, "source and binary forms", r"redistribution and use in source and binary forms (?:with or without modification )?(?:are|is) permitted"),
    ("bsd", 3, 0.9, "redistributions of source code", r"redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 3, 0.9, "redistributions in binary form", r"redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 3, 0.9, "endorse or promote", rf"neither the names? of {_SOME}(?:nor the names of (?:its|their) contributors )?may be used to endorse or promote products"),
    ("bsd", 3, 0.9, "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-clear", 2, 0.95, "patent rights", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache", 1, 1.0, "for use reproduction", r"terms and conditions for use reproduction and distribution 1 definitions"),
    ("apache", 2, 0.95, "may not use this file", r"you may not use this file except in compliance with the license"),
    ("apache", 2, 0.95, "grant of copyright", r"grant of copyright license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache", 2, 0.95, "grant of patent", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache", 3, 0.9, "express or implied see", r"distributed on an as is basis without warranties or conditions of any kind either express or implied see the license"),
    ("apache", 3, 0.9, "the apache", r"this product includes software developed (?:by|at) the apache (?:software foundation|group)"),
    ("gpl", 1, 1.0, "is free software", r"this (?:program|file|library) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", 2, 0.95, "copyleft", r"the gnu general public licen[cs]e is a free copyleft licen[cs]e for software"),
    ("gpl", 2, 0.95, "general public", r"you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("gpl", 2, 0.95, "free software foundation", r"gnu general public licen[cs]e as published by the free software foundation(?: either)?(?: version [0-9]+)?(?: of the licen[cs]e)?(?: or at your option any later version)?"),
    ("gpl", 3, 0.9, "share and change", r"designed to take away your freedom to share and change"),
    ("gpl", 3, 0.9, "special exception", r"as a special exception the copyright holders? of this (?:library|program) gives? you permission to link"),
    ("lgpl", 1, 1.0, "lesser general", r"redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("lgpl", 1, 1.0, "library general", r"redistribute it and or modify it under the terms of the gnu library general public licen[cs]e"),
    ("lgpl", 2, 0.95, "lesser general", r"you should have received a copy of the gnu lesser general public licen[cs]e along with"),
    ("lgpl", 2, 0.95, "successor of the gnu", r"this is the first released version of the lesser gpl it also counts as the successor of the gnu library public licen[cs]e"),
    ("agpl", 1, 1.0, "affero general", r"redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("agpl", 2, 0.95, "affero general", r"you should have received a copy of the gnu affero general public licen[cs]e along with"),
    ("agpl", 2, 0.95, "remote network interaction", r"remote network interaction use with the gnu general public licen[cs]e"),
    ("gfdl", 1, 1.0, "free documentation", r"copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", 3, 0.9, "invariant sections", r"with no invariant sections (?:with )?no front cover texts (?:and )?(?:with )?no back cover texts"),
    ("mpl", 1, 1.0, "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", 2, 0.95, "mpl was not", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", 2, 0.95, "mozilla public", r"the contents of this file are subject to the mozilla public licen[cs]e"),
    ("mpl", 3, 0.9, "secondary licen", r"this source code form is incompatible with secondary licen[cs]es"),
    ("epl", 1, 1.0, "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("epl", 2, 0.95, "recipient s acceptance", r"constitutes recipient s acceptance of this agreement"),
    ("cddl", 1, 1.0, "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cddl", 3, 0.9, "fields enclosed", r"with the fields enclosed by brackets replaced with your own identifying information"),
    ("cpl", 2, 0.95, "common public", r"the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("eupl", 2, 0.95, "licensed under the eupl", r"licensed under the eupl(?: version)?(?: [0-9]+(?: [0-9]+)?)?(?: or later)?"),
    ("cecill", 2, 0.95, "cecill", r"governed by the cecill(?: [bc])? licen[cs]e under french law"),
    ("zlib", 1, 1.0, "altered from any source", r"this notice may not be removed or altered from any source distribution"),
    ("zlib", 2, 0.95, "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 2, 0.95, "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("boost", 1, 1.0, "machine executable object", r"in the form of machine executable object code generated by a source language processor"),
    ("boost", 2, 0.95, "covered by this license", r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("artistic", 2, 0.95, "artistic control", r"the copyright holder maintains some semblance of artistic control"),
    ("artistic", 3, 0.9, "standard version", r"you may distribute verbatim copies of the source form of the standard version"),
    ("perl", 2, 0.95, "same terms as perl", r"(?:redistribute it and or modify it )?under the same terms as perl(?: [0-9]+)? itself"),
    ("python", 2, 0.95, "python software foundation", r"python software foundation licen[cs]e(?: version [0-9]+)?"),
    ("ruby", 3, 0.9, "same terms as ruby", r"(?:under|on) the same terms as ruby(?: itself)?"),
    ("php", 2, 0.95, "php licen", r"this source file is subject to version [0-9]+ [0-9]+ of the php licen[cs]e"),
    ("openssl", 2, 0.95, "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("unlicense", 1, 1.0, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 2, 0.95, "jurisdictions that recognize", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"),
    ("wtfpl", 1, 1.0, "do what the fuck", r"do what the fuck you want to(?: public licen[cs]e)?"),
    ("beerware", 1, 1.0, "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("json", 1, 1.0, "not evil", r"the software shall be used for good not evil"),
    ("ofl", 1, 1.0, "open font", r"this font software is licensed under the sil open font licen[cs]e(?: version [0-9]+(?: [0-9]+)?)?"),
    ("ofl", 3, 0.9, "reserved font name", r"with reserved font names?"),
    ("cc0", 1, 1.0, "associated a work", r"the person who associated a work with this deed has dedicated the work to the public domain by waiving"),
    ("cc0", 2, 0.95, "waived all copyright", r"(?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("cc-by", 2, 0.95, "appropriate credit", r"you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"),
    ("cc-by-sa", 2, 0.95, "same license as the original", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", 2, 0.95, "modified material", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("public-domain", 3, 0.9, "public domain", r"(?:has been |is |are |was |hereby )?(?:released|placed|put) in(?:to)? the public domain"),
    ("public-domain", 3, 0.9, "no rights reserved", r"no rights reserved"),
    ("proprietary", 2, 0.95, "proprietary and confidential", r"(?:strictly )?proprietary and confidential"),
    ("proprietary", 2, 0.95, "unauthori", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
    ("proprietary", 5, 0.7, "all rights reserved", r"all rights reserved"),
    ("sspl", 1, 1.0, "server side public", r"server side public licen[cs]e(?: version [0-9]+)?"),
    ("busl", 1, 1.0, "business source", r"business source licen[cs]e(?: [0-9]+(?: [0-9]+)?)?"),
    ("elastic", 1, 1.0, "elastic licen", r"elastic licen[cs]e(?: [0-9]+(?: [0-9]+)?)?"),
    ("odbl", 1, 1.0, "database licen", r"open (?:data commons )?(?:open )?database licen[cs]e"),
    ("odc-by", 1, 1.0, "open data commons", r"open data commons attribution licen[cs]e"),
    ("ogl", 1, 1.0, "open government", r"(?:contains public sector information licensed under the )?open government licen[cs]e(?: v?[0-9]+(?: [0-9]+)?)?"),
)

# Identifiers in a file's head: the label and the words after "spdx license identifier".
IDENTIFIERS = (
    ("mit", r"mit"), ("mit-0", r"mit 0"), ("x11", r"x11"), ("isc", r"isc"), ("0bsd", r"0bsd"),
    ("bsd", r"bsd [1234] clause"), ("bsd-clear", r"bsd 3 clause clear"), ("apache", r"apache [12] [01]"),
    ("gpl", r"gpl [123] 0(?: only| or later)?"), ("lgpl", r"lgpl [23] [01](?: only| or later)?"),
    ("agpl", r"agpl [13] 0(?: only| or later)?"), ("gfdl", r"gfdl 1 [123](?: only| or later)?"),
    ("mpl", r"mpl [12] [01]"), ("epl", r"epl [12] 0"), ("cpl", r"cpl 1 0"), ("cddl", r"cddl 1 [01]"),
    ("eupl", r"eupl 1 [012]"), ("cecill", r"cecill(?: [12] [01]| [bc])?"), ("zlib", r"zlib"),
    ("boost", r"bsl 1 0"), ("busl", r"busl 1 1"), ("artistic", r"artistic [12] 0(?: perl)?"),
    ("python", r"psf 2 0"), ("ruby", r"ruby"), ("php", r"php 3 0[01]?"), ("openssl", r"openssl"),
    ("unlicense", r"unlicense"), ("wtfpl", r"wtfpl"), ("beerware", r"beerware"), ("json", r"json"),
    ("ofl", r"ofl 1 [01](?: r?fn| no rfn)?"), ("cc0", r"cc0 1 0"), ("cc-by", r"cc by [1234] [05]"),
    ("cc-by-nc", r"cc by nc(?: sa| nd)? [1234] [05]"), ("cc-by-sa", r"cc by sa [1234] [05]"),
    ("cc-by-nd", r"cc by nd [1234] [05]"), ("sspl", r"sspl 1 0"), ("elastic", r"elastic 2 0"),
    ("odbl", r"odbl 1 0"), ("hpnd", r"hpnd"),
)

# Addresses of license texts, as their words read.
ADDRESSES = (
    ("apache", "apache org licenses", r"apache org licenses(?: license 2 0)?"),
    ("mit", "org licenses mit", r"opensource org licenses mit(?: license)?"),
    ("isc", "org licenses isc", r"opensource org licenses isc(?: license)?"),
    ("bsd", "org licenses bsd", r"opensource org licenses bsd(?: [23] clause| license)?"),
    ("gpl", "gnu org", r"gnu org (?:licenses|copyleft) gpl(?: [23] 0)?"),
    ("lgpl", "gnu org", r"gnu org (?:licenses|copyleft) lgpl(?: [23] [01])?"),
    ("agpl", "gnu org", r"gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", "gnu org", r"gnu org (?:licenses|copyleft) fdl(?: 1 [123])?"),
    ("mpl", "mozilla org", r"mozilla org mpl(?: [12] [01])?"),
    ("epl", "eclipse org", r"eclipse org (?:legal|org documents) epl(?: v10| 2 0| v20)?"),
    ("boost", "boost org", r"boost org license 1 0"),
    ("unlicense", "unlicense org", r"unlicense org"),
    ("wtfpl", "wtfpl net", r"wtfpl net"),
    ("ofl", "scripts sil org", r"scripts sil org ofl"),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark(?: 1 0)?"),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by(?: [1234] [05])?"),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc(?: sa| nd)?(?: [1234] [05])?"),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa(?: [1234] [05])?"),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd(?: [1234] [05])?"),
    ("odbl", "opendatacommons org", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", "opendatacommons org", r"opendatacommons org licenses by(?: 1 0)?"),
)

# Sentences that deny a license: what follows is no grant.
DENIALS = (
    ("under", rf"(?:not|never|no longer|cannot|neither) (?:be |been |currently |yet )?(?:re)?(?:licen[cs]ed|released|published|distributed|provided|available|offered) under {_ANY}"),
    ("covered by", rf"(?:not|never|no longer) (?:be |been )?covered by {_ANY}"),
    ("subject to", rf"not (?:be )?subject to {_ANY}"),
    ("governed by", rf"not (?:be )?governed by {_ANY}"),
    ("compatible with", rf"(?:in|not )compatible with {_ANY}"),
    ("instead of", rf"instead of {_ANY}"),
    ("rather than", rf"rather than {_ANY}"),
    ("other than", rf"other than {_ANY}"),
    ("public domain", r"not (?:been |yet )?(?:released |placed |put )?in(?:to)? the public domain"),
)
