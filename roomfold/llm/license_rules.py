"""Signature rules of the licence scan, written for normalised text: lower-case words with one space between."""

from __future__ import annotations

#: Kind of rule: priority in the suppression, confidence of a detection.
KINDS = {"tag": (4, 0.99), "notice": (3, 0.95), "link": (2, 0.9), "name": (1, 0.7), "mention": (0, 0.4)}

# One rule per line: kind | label | keyword that must occur | regular expression over words.
_RULES = r"""
tag | mit | spdx license | spdx license identifier mit
tag | mit-0 | spdx license | spdx license identifier mit 0
tag | apache-1.1 | spdx license | spdx license identifier apache 1 1
tag | apache-2.0 | spdx license | spdx license identifier apache 2 0
tag | gpl-1.0 | spdx license | spdx license identifier gpl 1 0( only| or later)?
tag | gpl-2.0 | spdx license | spdx license identifier gpl 2 0( only| or later)?
tag | gpl-3.0 | spdx license | spdx license identifier gpl 3 0( only| or later)?
tag | lgpl-2.0 | spdx license | spdx license identifier lgpl 2 0( only| or later)?
tag | lgpl-2.1 | spdx license | spdx license identifier lgpl 2 1( only| or later)?
tag | lgpl-3.0 | spdx license | spdx license identifier lgpl 3 0( only| or later)?
tag | agpl-3.0 | spdx license | spdx license identifier agpl 3 0( only| or later)?
tag | bsd-2-clause | spdx license | spdx license identifier bsd 2 clause
tag | bsd-3-clause | spdx license | spdx license identifier bsd 3 clause
tag | bsd-4-clause | spdx license | spdx license identifier bsd 4 clause
tag | 0bsd | spdx license | spdx license identifier 0bsd
tag | isc | spdx license | spdx license identifier isc
tag | mpl-1.1 | spdx license | spdx license identifier mpl 1 1
tag | mpl-2.0 | spdx license | spdx license identifier mpl 2 0
tag | epl-1.0 | spdx license | spdx license identifier epl 1 0
tag | epl-2.0 | spdx license | spdx license identifier epl 2 0
tag | cddl-1.0 | spdx license | spdx license identifier cddl 1 0
tag | cddl-1.1 | spdx license | spdx license identifier cddl 1 1
tag | cc0-1.0 | spdx license | spdx license identifier cc0 1 0
tag | unlicense | spdx license | spdx license identifier unlicense
tag | wtfpl | spdx license | spdx license identifier wtfpl
tag | zlib | spdx license | spdx license identifier zlib
tag | bsl-1.0 | spdx license | spdx license identifier bsl 1 0
tag | artistic-1.0 | spdx license | spdx license identifier artistic 1 0
tag | artistic-2.0 | spdx license | spdx license identifier artistic 2 0
tag | ofl-1.1 | spdx license | spdx license identifier ofl 1 1
tag | eupl-1.1 | spdx license | spdx license identifier eupl 1 1
tag | eupl-1.2 | spdx license | spdx license identifier eupl 1 2
tag | psf-2.0 | spdx license | spdx license identifier (psf|python) 2 0
tag | postgresql | spdx license | spdx license identifier postgresql
tag | openssl | spdx license | spdx license identifier openssl
tag | ncsa | spdx license | spdx license identifier ncsa
tag | ms-pl | spdx license | spdx license identifier ms pl
tag | ms-rl | spdx license | spdx license identifier ms rl
tag | afl-3.0 | spdx license | spdx license identifier afl 3 0
tag | osl-3.0 | spdx license | spdx license identifier osl 3 0
tag | ecl-2.0 | spdx license | spdx license identifier ecl 2 0
tag | upl-1.0 | spdx license | spdx license identifier upl 1 0
tag | cecill-2.1 | spdx license | spdx license identifier cecill 2 1
tag | gfdl-1.3 | spdx license | spdx license identifier gfdl 1 3( only| or later)?
tag | odbl-1.0 | spdx license | spdx license identifier odbl 1 0
tag | cc-by-3.0 | spdx license | spdx license identifier cc by 3 0
tag | cc-by-4.0 | spdx license | spdx license identifier cc by 4 0
tag | cc-by-sa-3.0 | spdx license | spdx license identifier cc by sa 3 0
tag | cc-by-sa-4.0 | spdx license | spdx license identifier cc by sa 4 0
tag | cc-by-nc-4.0 | spdx license | spdx license identifier cc by nc 4 0
tag | cc-by-nc-sa-4.0 | spdx license | spdx license identifier cc by nc sa 4 0
tag | cc-by-nc-nd-4.0 | spdx license | spdx license identifier cc by nc nd 4 0
tag | cc-by-nd-4.0 | spdx license | spdx license identifier cc by nd 4 0
tag | unknown-spdx | spdx license | spdx license identifier [0-9a-z]+
notice | mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
notice | mit | without restriction including without limitation | without restriction including without limitation the rights to use copy modify merge publish distribute
notice | mit | mit license | (released|licensed|distributed|available|published) under( the terms of)? (the|an) mit licen[sc]e
notice | apache-2.0 | apache license version 2 | (released|licensed|distributed|available|published) under( the terms of)? the apache license version 2( 0)?
notice | apache-2.0 | you may not use this file except in compliance | you may not use this file except in compliance with the license
notice | apache-1.1 | apache license version 1 | (released|licensed|distributed) under the apache license version 1 1
notice | gpl | gnu general public license | (released|licensed|distributed|available|published) under( the terms of)? the gnu general public license
notice | gpl-2.0 | gnu general public license | gnu general public license( as published by the free software foundation)?( either)? version 2
notice | gpl-3.0 | gnu general public license | gnu general public license( as published by the free software foundation)?( either)? version 3
notice | gpl-2.0-or-later | or at your option any later version | either version 2 of the license or at your option any later version
notice | gpl-3.0-or-later | or at your option any later version | either version 3 of the license or at your option any later version
notice | lgpl-2.1 | gnu lesser general public license | gnu lesser general public license( as published by the free software foundation)?( either)? version 2 1
notice | lgpl-3.0 | gnu lesser general public license | gnu lesser general public license( as published by the free software foundation)?( either)? version 3
notice | lgpl-2.0 | gnu library general public license | gnu library general public license( as published by the free software foundation)?( either)? version 2
notice | agpl-3.0 | gnu affero general public license | gnu affero general public license( as published by the free software foundation)?( either)? version 3
notice | gfdl | gnu free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
notice | gfdl-1.2 | gnu free documentation license | gnu free documentation license version 1 2
notice | gfdl-1.3 | gnu free documentation license | gnu free documentation license version 1 3
notice | bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
notice | bsd-3-clause | may be used to endorse or promote products | neither the names? of .{1,80} may be used to endorse or promote products
notice | bsd-4-clause | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display
notice | bsd-2-clause | bsd 2 clause | (released|licensed|distributed) under( the terms of)? the bsd 2 clause licen[sc]e
notice | bsd-3-clause | bsd 3 clause | (released|licensed|distributed) under( the terms of)? the bsd 3 clause licen[sc]e
notice | isc | permission to use copy modify and | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
notice | mpl-1.1 | mozilla public license | mozilla public license version 1 1
notice | mpl-2.0 | mozilla public license | mozilla public license v(ersion)? ?2( 0)?
notice | mpl-2.0 | this source code form is subject | this source code form is subject to the terms of the mozilla public license v 2 0
notice | epl-1.0 | eclipse public license | eclipse public license( v|version)? ?v?1 0
notice | epl-2.0 | eclipse public license | eclipse public license( v|version)? ?v?2 0
notice | cddl-1.0 | common development and distribution license | common development and distribution license( cddl)? version 1 0
notice | cddl-1.1 | common development and distribution license | common development and distribution license( cddl)? version 1 1
notice | unlicense | released into the public domain | this is free and unencumbered software released into the public domain
notice | public-domain | public domain | (released|placed|dedicated) (in|in to|into|to) the public domain
notice | public-domain | public domain | (is|are) in the public domain
notice | cc0-1.0 | cc0 1 0 | cc0 1 0 universal( public domain dedication)?
notice | zlib | altered source versions must be plainly marked | altered source versions must be plainly marked as such
notice | bsl-1.0 | boost software license | boost software license version 1 0
notice | artistic-1.0 | artistic license | artistic license( version)? 1 0
notice | artistic-2.0 | artistic license | artistic license( version)? 2 0
notice | ofl-1.1 | sil open font license | sil open font license version 1 1
notice | eupl-1.1 | european union public licen | european union public licen[sc]e( eupl)?( version)? ?v ?1 1
notice | eupl-1.2 | european union public licen | european union public licen[sc]e( eupl)?( version)? ?v ?1 2
notice | psf-2.0 | python software foundation license | python software foundation license version 2
notice | wtfpl | want to public licen | do what the [a-z]+ you want to public license
notice | openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
notice | proprietary | license agreement | (governed by|subject to) the( terms of the)? (software |end user )?license agreement
notice | proprietary | all rights reserved | copyright.{0,60} all rights reserved
notice | proprietary | confidential and proprietary | confidential and proprietary (information|material|software)
notice | no-redistribution | licen | (may not|must not|shall not) be (copied|redistributed|reproduced)( or [a-z]+)? without( a)?( prior)?( written)? licen[sc]e
notice | cc-by-4.0 | cc by 4 | (released|licensed|available|published) under( a| the)? cc by 4 0
notice | cc-by-3.0 | cc by 3 | (released|licensed|available|published) under( a| the)? cc by 3 0
notice | cc-by-sa-4.0 | cc by sa 4 | (released|licensed|available|published) under( a| the)? cc by sa 4 0
notice | cc-by-sa-3.0 | cc by sa 3 | (released|licensed|available|published) under( a| the)? cc by sa 3 0
notice | cc-by-nc-4.0 | cc by nc 4 | (released|licensed|available|published) under( a| the)? cc by nc 4 0
notice | cc-by-nc-3.0 | cc by nc 3 | (released|licensed|available|published) under( a| the)? cc by nc 3 0
notice | cc-by-nc-sa-4.0 | cc by nc sa 4 | (released|licensed|available|published) under( a| the)? cc by nc sa 4 0
notice | cc-by-nc-nd-4.0 | cc by nc nd 4 | (released|licensed|available|published) under( a| the)? cc by nc nd 4 0
notice | cc-by-nd-4.0 | cc by nd 4 | (released|licensed|available|published) under( a| the)? cc by nd 4 0
notice | cc-by-4.0 | creative commons attribution | creative commons attribution 4 0( international)?( public)? licen[sc]e
notice | cc-by-3.0 | creative commons attribution | creative commons attribution 3 0( unported)? licen[sc]e
notice | cc-by-sa-4.0 | creative commons attribution | creative commons attribution share ?alike 4 0( international)?( public)? licen[sc]e
notice | cc-by-sa-3.0 | creative commons attribution | creative commons attribution share ?alike 3 0( unported)? licen[sc]e
notice | cc-by-nc-4.0 | creative commons attribution | creative commons attribution non ?commercial 4 0( international)?( public)? licen[sc]e
notice | cc-by-nc-sa-4.0 | creative commons attribution | creative commons attribution non ?commercial share ?alike 4 0( international)?( public)? licen[sc]e
notice | cc-by-nc-nd-4.0 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)?( public)? licen[sc]e
notice | cc-by-nd-4.0 | creative commons attribution | creative commons attribution no ?deriv(ative)?s 4 0( international)?( public)? licen[sc]e
link | mit | opensource org licen | opensource org licenses? mit( license)?( php| html)?
link | apache-2.0 | apache org licen | apache org licenses license 2 0( txt| html)?
link | apache-2.0 | opensource org licen | opensource org licenses? apache 2 0
link | bsd-2-clause | opensource org licen | opensource org licenses? bsd 2 clause
link | bsd-3-clause | opensource org licen | opensource org licenses? bsd 3 clause
link | isc | opensource org licen | opensource org licenses? isc
link | mpl-2.0 | opensource org licen | opensource org licenses? mpl 2 0
link | artistic-2.0 | opensource org licen | opensource org licenses? artistic( license)? 2 0
link | gpl-2.0 | opensource org licen | opensource org licenses? gpl 2 0
link | gpl-3.0 | opensource org licen | opensource org licenses? gpl 3 0
link | lgpl-2.1 | opensource org licen | opensource org licenses? lgpl 2 1
link | lgpl-3.0 | opensource org licen | opensource org licenses? lgpl 3 0
link | epl-2.0 | opensource org licen | opensource org licenses? epl 2 0
link | cddl-1.0 | opensource org licen | opensource org licenses? cddl ?1( 0)?
link | zlib | opensource org licen | opensource org licenses? zlib
link | bsl-1.0 | boost org license | boost org license 1 0( txt)?
link | gpl | gnu org licen | gnu org licenses? gpl( html| txt)?
link | gpl-2.0 | gnu org licen | gnu org licenses? (old licenses )?gpl 2 0( html| txt)?
link | gpl-3.0 | gnu org licen | gnu org licenses? gpl 3 0( html| txt)?
link | lgpl | gnu org licen | gnu org licenses? lgpl( html| txt)?
link | lgpl-2.1 | gnu org licen | gnu org licenses? (old licenses )?lgpl 2 1( html| txt)?
link | lgpl-3.0 | gnu org licen | gnu org licenses? lgpl 3 0( html| txt)?
link | agpl-3.0 | gnu org licen | gnu org licenses? agpl 3 0( html| txt)?
link | gfdl | gnu org licen | gnu org licenses? fdl( html| txt)?
link | mpl-2.0 | mozilla org mpl | mozilla org mpl 2 0
link | mpl-1.1 | mozilla org mpl | mozilla org mpl mpl 1 1( html| txt)?
link | epl-1.0 | eclipse org legal | eclipse org legal epl v ?10( html)?
link | epl-2.0 | eclipse org legal | eclipse org legal epl (2 0|v ?20)( html)?
link | unlicense | unlicense org | unlicense org
link | cc0-1.0 | creativecommons org publicdomain | creativecommons org publicdomain zero 1 0
link | public-domain | creativecommons org publicdomain | creativecommons org publicdomain mark 1 0
link | cc-by-2.0 | creativecommons org licen | creativecommons org licenses by 2 [05]
link | cc-by-3.0 | creativecommons org licen | creativecommons org licenses by 3 0
link | cc-by-4.0 | creativecommons org licen | creativecommons org licenses by 4 0
link | cc-by-sa-2.0 | creativecommons org licen | creativecommons org licenses by sa 2 [05]
link | cc-by-sa-3.0 | creativecommons org licen | creativecommons org licenses by sa 3 0
link | cc-by-sa-4.0 | creativecommons org licen | creativecommons org licenses by sa 4 0
link | cc-by-nc-2.0 | creativecommons org licen | creativecommons org licenses by nc 2 [05]
link | cc-by-nc-3.0 | creativecommons org licen | creativecommons org licenses by nc 3 0
link | cc-by-nc-4.0 | creativecommons org licen | creativecommons org licenses by nc 4 0
link | cc-by-nd-3.0 | creativecommons org licen | creativecommons org licenses by nd 3 0
link | cc-by-nd-4.0 | creativecommons org licen | creativecommons org licenses by nd 4 0
link | cc-by-nc-sa-3.0 | creativecommons org licen | creativecommons org licenses by nc sa 3 0
link | cc-by-nc-sa-4.0 | creativecommons org licen | creativecommons org licenses by nc sa 4 0
link | cc-by-nc-nd-3.0 | creativecommons org licen | creativecommons org licenses by nc nd 3 0
link | cc-by-nc-nd-4.0 | creativecommons org licen | creativecommons org licenses by nc nd 4 0
link | ofl-1.1 | scripts sil org ofl | scripts sil org ofl
link | wtfpl | wtfpl net | wtfpl net( txt copying)?
link | odbl-1.0 | opendatacommons org licen | opendatacommons org licenses odbl( 1 0)?
link | odc-by-1.0 | opendatacommons org licen | opendatacommons org licenses by( 1 0)?
link | pddl-1.0 | opendatacommons org licen | opendatacommons org licenses pddl( 1 0)?
name | mit | mit licen | mit licen[sc]e
name | mit | x11 licen | (mit )?x11 licen[sc]e
name | mit | expat licen | expat licen[sc]e
name | apache | apache licen | apache licen[sc]e
name | apache-2.0 | apache | apache( software)? licen[sc]e( version| v)? ?2( 0)?
name | apache-2.0 | apache 2 0 licen | apache 2 0 licen[sc]e
name | gpl | gnu general public licen | gnu general public licen[sc]e
name | gpl | gnu gpl | gnu gpl
name | gpl-2.0 | gpl | gpl ?v?(ersion )?2( 0)?
name | gpl-3.0 | gpl | gpl ?v?(ersion )?3( 0)?
name | lgpl | general public licen | gnu (lesser|library) general public licen[sc]e
name | lgpl | gnu lgpl | gnu lgpl
name | lgpl-2.1 | lgpl | lgpl ?v?2 1
name | lgpl-3.0 | lgpl | lgpl ?v?3( 0)?
name | agpl | affero general public licen | (gnu )?affero general public licen[sc]e
name | agpl-3.0 | agpl | agpl ?v?3( 0)?
name | gfdl | free documentation licen | (gnu )?free documentation licen[sc]e
name | bsd | bsd licen | bsd licen[sc]e
name | bsd | bsd style licen | bsd style licen[sc]e
name | bsd-2-clause | clause bsd | (2|two) clause bsd( licen[sc]e)?
name | bsd-3-clause | clause bsd | (3|three) clause bsd( licen[sc]e)?
name | bsd-4-clause | clause bsd | (4|four) clause bsd( licen[sc]e)?
name | bsd-2-clause | simplified bsd | simplified bsd licen[sc]e
name | bsd-3-clause | modified bsd | (modified|new|revised) bsd licen[sc]e
name | bsd-3-clause | new bsd | new bsd licen[sc]e
name | isc | isc licen | isc licen[sc]e
name | mpl | mozilla public licen | mozilla public licen[sc]e
name | epl | eclipse public licen | eclipse public licen[sc]e
name | cddl | common development and distribution licen | common development and distribution licen[sc]e
name | cpl-1.0 | common public licen | common public licen[sc]e( version)?( 1 0)?
name | ipl-1.0 | ibm public licen | ibm public licen[sc]e( version)?( 1 0)?
name | unlicense | the unlicense | the unlicense
name | wtfpl | wtfpl | wtfpl( licen[sc]e)?
name | zlib | zlib licen | zlib( libpng)? licen[sc]e
name | zlib | zlib libpng licen | zlib libpng licen[sc]e
name | bsl-1.0 | boost software licen | boost software licen[sc]e
name | artistic | artistic licen | artistic licen[sc]e
name | ofl-1.1 | open font licen | (sil )?open font licen[sc]e
name | eupl | european union public licen | european union public licen[sc]e
name | psf | python software foundation licen | python software foundation licen[sc]e
name | postgresql | postgresql licen | postgresql licen[sc]e
name | openssl | openssl licen | openssl licen[sc]e
name | php-3.01 | php licen | php licen[sc]e( version)?( 3 01)?
name | ruby | ruby licen | ruby licen[sc]e
name | ncsa | ncsa open source licen | (university of illinois )?ncsa open source licen[sc]e
name | ms-pl | microsoft public licen | microsoft public licen[sc]e
name | ms-rl | microsoft reciprocal licen | microsoft reciprocal licen[sc]e
name | afl-3.0 | academic free licen | academic free licen[sc]e( version)?( 3 0)?
name | osl-3.0 | open software licen | open software licen[sc]e( version)?( 3 0)?
name | ecl-2.0 | educational community licen | educational community licen[sc]e( version)?( 2 0)?
name | upl-1.0 | universal permissive licen | universal permissive licen[sc]e( version)?( 1 0)?
name | cecill | cecill | cecill( licen[sc]e)?
name | odbl-1.0 | open database licen | open database licen[sc]e
name | odc-by-1.0 | open data commons attribution licen | open data commons attribution licen[sc]e
name | vim | vim licen | vim licen[sc]e
name | qpl-1.0 | q public licen | q public licen[sc]e( version)?( 1 0)?
name | rpl-1.5 | reciprocal public licen | reciprocal public licen[sc]e( version)?( 1 5)?
name | sspl-1.0 | server side public licen | server side public licen[sc]e
name | busl-1.1 | business source licen | business source licen[sc]e( version)?( 1 1)?
name | elastic-2.0 | elastic licen | elastic licen[sc]e( version)?( 2 0)?
name | apsl-2.0 | apple public source licen | apple public source licen[sc]e( version)?( 2 0)?
name | ogl-3.0 | open government licen | open government licen[sc]e( version| v)?( 3 0)?
name | cc0-1.0 | cc0 | cc0( 1 0| licen[sc]e)?
name | cc-by | cc by | cc by
name | cc-by-2.0 | cc by | cc by 2 [05]
name | cc-by-3.0 | cc by | cc by 3 0
name | cc-by-4.0 | cc by | cc by 4 0
name | cc-by-sa | cc by sa | cc by sa
name | cc-by-sa-2.0 | cc by sa | cc by sa 2 [05]
name | cc-by-sa-3.0 | cc by sa | cc by sa 3 0
name | cc-by-sa-4.0 | cc by sa | cc by sa 4 0
name | cc-by-nc | cc by nc | cc by nc
name | cc-by-nc-2.0 | cc by nc | cc by nc 2 [05]
name | cc-by-nc-3.0 | cc by nc | cc by nc 3 0
name | cc-by-nc-4.0 | cc by nc | cc by nc 4 0
name | cc-by-nd | cc by nd | cc by nd
name | cc-by-nd-3.0 | cc by nd | cc by nd 3 0
name | cc-by-nd-4.0 | cc by nd | cc by nd 4 0
name | cc-by-nc-sa | cc by nc sa | cc by nc sa
name | cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3 0
name | cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
name | cc-by-nc-nd | cc by nc nd | cc by nc nd
name | cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd 3 0
name | cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
name | cc-by | creative commons attribution | creative commons attribution licen[sc]e
name | cc-by-sa | creative commons attribution | creative commons attribution share ?alike licen[sc]e
name | cc-by-nc | creative commons attribution | creative commons attribution non ?commercial licen[sc]e
name | cc | creative commons | creative commons licen[sc]e
name | proprietary | proprietary licen | proprietary licen[sc]e
name | proprietary | commercial licen | commercial licen[sc]e
name | shareware | shareware licen | shareware licen[sc]e
name | freeware | freeware licen | freeware licen[sc]e
name | eula | end user licen | end user licen[sc]e agreement
mention | copyleft | copyleft | copyleft licen[sc]e
mention | permissive | permissive licen | permissive licen[sc]e
mention | open-source | open source licen | open source licen[sc]e
"""

#: (priority, confidence, label, keyword, regular expression)
RULES = [(*KINDS[kind], label, keyword, regex) for kind, label, keyword, regex in
         ([part.strip() for part in line.split(" | ")] for line in _RULES.strip().splitlines())]

#: Whole-text prefilter: a lower-cased text with none of these holds no keyword of any rule.
GATE = ["licen", "copyright", "gpl", "cc0", "public", "creative", "copyleft", "wtfpl", "apache", "cecill", "mozilla",
        "openssl", "rights reserved", "warrant", "permission", "restriction", "proprietary", "source", "endorse",
        "advertis", "bsd", "eclipse", "cc", "later version", "scripts", "compliance", "affero", "publicdomain",
        "opendatacommons"]
