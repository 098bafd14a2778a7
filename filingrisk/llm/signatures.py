"""License signatures: priority | label | keyword | pattern over lower-case words.

A blank in a pattern stands for any run of separators. The keyword is one word
and must occur in whatever the pattern matches. Priority 0 holds the base phrases, 1 full
names with versions and tags, 2 unversioned names and addresses, 3 grant
sentences, 4 short references.
"""

RULES = r"""
0 | gpl | license | gnu general public license
0 | apache | license | apache license
0 | cc-by | cc | cc by
0 | mit | license | mit license
1 | gpl-1.0 | general | gnu general public licen[sc]e,? (?:version|v) ?1(?: 0)?
1 | gpl-1.0 | gpl | (?:gnu )?gpl v?1(?: 0)?(?: only| or later)?
1 | gpl-2.0 | general | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:version|v) ?2(?: 0)?
1 | gpl-2.0 | gpl | (?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?
1 | gpl-2.0 | gpl | gplv2(?: 0)?
1 | gpl-2.0 | general | version 2 of the gnu general public licen[sc]e
1 | gpl-2.0 | general | general public licen[sc]e version 2 june 1991
1 | gpl-3.0 | general | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:version|v) ?3(?: 0)?
1 | gpl-3.0 | gpl | (?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?
1 | gpl-3.0 | gpl | gplv3(?: 0)?
1 | gpl-3.0 | general | version 3 of the gnu general public licen[sc]e
1 | gpl-3.0 | general | general public licen[sc]e version 3 29 june 2007
1 | lgpl-2.0 | library | gnu library general public licen[sc]e(?: (?:version|v) ?2(?: 0)?)?
1 | lgpl-2.0 | lgpl | lgpl ?v?2 0(?: only| or later)?
1 | lgpl-2.1 | lesser | gnu lesser general public licen[sc]e (?:version|v) ?2 1
1 | lgpl-2.1 | lgpl | (?:gnu )?lgpl ?v?2 1(?: only| or later)?
1 | lgpl-2.1 | lgpl | lgplv2 1
1 | lgpl-2.1 | lesser | version 2 1 of the gnu lesser general public licen[sc]e
1 | lgpl-3.0 | lesser | gnu lesser general public licen[sc]e (?:version|v) ?3(?: 0)?
1 | lgpl-3.0 | lgpl | (?:gnu )?lgpl ?v?3(?: 0)?(?: only| or later)?
1 | lgpl-3.0 | lgpl | lgplv3
1 | agpl-1.0 | affero | affero general public licen[sc]e (?:version|v) ?1(?: 0)?
1 | agpl-3.0 | affero | (?:gnu )?affero general public licen[sc]e (?:version|v) ?3(?: 0)?
1 | agpl-3.0 | agpl | (?:gnu )?agpl ?v?3(?: 0)?(?: only| or later)?
1 | agpl-3.0 | agpl | agplv3
1 | gfdl-1.1 | documentation | gnu free documentation licen[sc]e (?:version|v) ?1 1
1 | gfdl-1.2 | documentation | gnu free documentation licen[sc]e (?:version|v) ?1 2
1 | gfdl-1.3 | documentation | gnu free documentation licen[sc]e (?:version|v) ?1 3
1 | apache-1.0 | apache | apache (?:software )?licen[sc]e (?:version |v)?1 0
1 | apache-1.1 | apache | apache (?:software )?licen[sc]e (?:version |v)?1 1
1 | apache-2.0 | apache | apache (?:software )?licen[sc]e (?:version |v)?2(?: 0)?
1 | apache-2.0 | apache | apache ?v?2 0
1 | apache-2.0 | asl | asl ?v?2 0
1 | apache-2.0 | apache | version 2 0 of the apache licen[sc]e
1 | mpl-1.0 | mozilla | mozilla public licen[sc]e (?:version |v)?1 0
1 | mpl-1.1 | mozilla | mozilla public licen[sc]e (?:version |v)?1 1
1 | mpl-2.0 | mozilla | mozilla public licen[sc]e (?:version |v)?2 0
1 | mpl-1.1 | mpl | mpl ?v?1 1
1 | mpl-2.0 | mpl | mpl ?v?2 0
1 | epl-1.0 | eclipse | eclipse public licen[sc]e (?:version |v)?1 0
1 | epl-2.0 | eclipse | eclipse public licen[sc]e (?:version |v)?2 0
1 | epl-1.0 | epl | epl ?v?1 0
1 | epl-2.0 | epl | epl ?v?2 0
1 | edl-1.0 | eclipse | eclipse distribution licen[sc]e (?:version |v)?1 0
1 | cddl-1.0 | development | common development and distribution licen[sc]e(?: (?:version |v)?1 0)?
1 | cddl-1.1 | development | common development and distribution licen[sc]e (?:version |v)?1 1
1 | cddl-1.0 | cddl | cddl ?v?1 0
1 | cddl-1.1 | cddl | cddl ?v?1 1
1 | cpl-1.0 | common | common public licen[sc]e(?: (?:version |v)?1 0)?
1 | ipl-1.0 | ibm | ibm public licen[sc]e(?: (?:version |v)?1 0)?
1 | eupl-1.0 | eupl | eupl ?v?1 0
1 | eupl-1.1 | eupl | eupl ?v?1 1
1 | eupl-1.2 | eupl | eupl ?v?1 2
1 | eupl-1.1 | european | european union public licen[sc]e (?:version |v)?1 1
1 | eupl-1.2 | european | european union public licen[sc]e (?:version |v)?1 2
1 | osl-3.0 | software | open software licen[sc]e (?:version |v)?3 0
1 | osl-2.1 | software | open software licen[sc]e (?:version |v)?2 1
1 | afl-3.0 | academic | academic free licen[sc]e (?:version |v)?3 0
1 | afl-2.1 | academic | academic free licen[sc]e (?:version |v)?2 1
1 | artistic-1.0 | artistic | artistic licen[sc]e (?:version |v)?1 0
1 | artistic-2.0 | artistic | artistic licen[sc]e (?:version |v)?2 0
1 | bsl-1.0 | boost | boost software licen[sc]e(?: (?:version |v)?1 0)?
1 | busl-1.1 | business | business source licen[sc]e (?:version |v)?1 1
1 | busl-1.1 | busl | busl 1 1
1 | sspl-1.0 | server | server side public licen[sc]e(?: (?:version |v)?1)?
1 | sspl-1.0 | sspl | sspl ?v?1(?: 0)?
1 | elastic-2.0 | elastic | elastic licen[sc]e (?:version |v)?2(?: 0)?
1 | cecill-1.0 | cecill | cecill ?v?1(?: 0)?
1 | cecill-2.0 | cecill | cecill ?v?2(?: 0)?
1 | cecill-2.1 | cecill | cecill ?v?2 1
1 | cecill-b | cecill | cecill b
1 | cecill-c | cecill | cecill c
1 | zpl-2.0 | zope | zope public licen[sc]e (?:version |v)?2 0
1 | zpl-2.1 | zope | zope public licen[sc]e (?:version |v)?2 1
1 | php-3.0 | php | php licen[sc]e (?:version |v)?3 0(?:0)?
1 | php-3.01 | php | php licen[sc]e (?:version |v)?3 01
1 | psf-2.0 | python | python software foundation licen[sc]e(?: (?:version |v)?2)?
1 | python-2.0 | python | python licen[sc]e (?:version |v)?2 0
1 | ofl-1.0 | font | sil open font licen[sc]e (?:version |v)?1 0
1 | ofl-1.1 | font | sil open font licen[sc]e (?:version |v)?1 1
1 | ofl-1.1 | ofl | ofl ?v?1 1
1 | ms-pl | microsoft | microsoft public licen[sc]e
1 | ms-rl | microsoft | microsoft reciprocal licen[sc]e
1 | ncsa | illinois | university of illinois ncsa open source licen[sc]e
1 | w3c | w3c | w3c software (?:notice and )?licen[sc]e
1 | qpl-1.0 | public | q public licen[sc]e(?: (?:version |v)?1 0)?
1 | rpl-1.1 | reciprocal | reciprocal public licen[sc]e (?:version |v)?1 1
1 | rpl-1.5 | reciprocal | reciprocal public licen[sc]e (?:version |v)?1 5
1 | upl-1.0 | universal | universal permissive licen[sc]e(?: (?:version |v)?1 0)?
1 | mulan-psl-2.0 | mulan | mulan psl ?v?2
1 | mulan-psl-1.0 | mulan | mulan psl ?v?1
1 | wtfpl | wtfpl | wtfpl(?: v?2)?
1 | wtfpl | fuck | do what the fuck you want to public licen[sc]e
1 | vim | vim | vim licen[sc]e
1 | openssl | openssl | openssl licen[sc]e
1 | ssleay | ssleay | (?:original )?ssleay licen[sc]e
1 | lppl-1.3c | latex | latex project public licen[sc]e (?:version |v)?1 3c?
1 | lppl-1.0 | latex | latex project public licen[sc]e (?:version |v)?1 0
1 | nasa-1.3 | nasa | nasa open source agreement (?:version |v)?1 3
1 | odbl-1.0 | database | open (?:data commons open )?database licen[sc]e(?: (?:version |v)?1 0)?
1 | odbl-1.0 | odbl | odbl ?v?1 0
1 | odc-by-1.0 | commons | open data commons attribution licen[sc]e(?: (?:version |v)?1 0)?
1 | pddl-1.0 | domain | public domain dedication and licen[sc]e(?: (?:version |v)?1 0)?
1 | ogl-uk-3.0 | government | open government licen[sc]e (?:version |v)?3 0
1 | ogl-uk-2.0 | government | open government licen[sc]e (?:version |v)?2 0
1 | bsd-2-clause | bsd | (?:simplified|2 clause|two clause|freebsd) bsd(?: licen[sc]e)?
1 | bsd-2-clause | bsd | bsd (?:2|two) clause(?: simplified)?(?: licen[sc]e)?
1 | bsd-3-clause | bsd | (?:modified|revised|new|3 clause|three clause) bsd(?: licen[sc]e)?
1 | bsd-3-clause | bsd | bsd (?:3|three) clause(?: new| revised)?(?: licen[sc]e)?
1 | bsd-4-clause | bsd | (?:original|old|4 clause|four clause) bsd(?: licen[sc]e)?
1 | bsd-4-clause | bsd | bsd (?:4|four) clause(?: original)?(?: licen[sc]e)?
1 | 0bsd | bsd | (?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?
1 | mit-0 | mit | mit (?:0|no attribution)(?: licen[sc]e)?
1 | cc0-1.0 | cc0 | cc0 (?:v?1 0|universal)(?: universal)?
1 | cc-by-1.0 | cc | cc by 1 0
1 | cc-by-2.0 | cc | cc by 2 0
1 | cc-by-2.5 | cc | cc by 2 5
1 | cc-by-3.0 | cc | cc by 3 0
1 | cc-by-4.0 | cc | cc by 4 0
1 | cc-by-sa-2.0 | cc | cc by sa 2 0
1 | cc-by-sa-2.5 | cc | cc by sa 2 5
1 | cc-by-sa-3.0 | cc | cc by sa 3 0
1 | cc-by-sa-4.0 | cc | cc by sa 4 0
1 | cc-by-nd-3.0 | cc | cc by nd 3 0
1 | cc-by-nd-4.0 | cc | cc by nd 4 0
1 | cc-by-nc-2.0 | cc | cc by nc 2 0
1 | cc-by-nc-3.0 | cc | cc by nc 3 0
1 | cc-by-nc-4.0 | cc | cc by nc 4 0
1 | cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
1 | cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
1 | cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
1 | cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
1 | cc-by-3.0 | attribution | creative commons attribution 3 0(?: international| unported)?
1 | cc-by-4.0 | attribution | creative commons attribution 4 0(?: international)?
1 | cc-by-sa-3.0 | sharealike | creative commons attribution sharealike 3 0(?: international| unported)?
1 | cc-by-sa-4.0 | sharealike | creative commons attribution sharealike 4 0(?: international)?
1 | cc-by-nc-4.0 | noncommercial | creative commons attribution noncommercial 4 0(?: international)?
1 | cc-by-nc-sa-4.0 | noncommercial | creative commons attribution noncommercial sharealike 4 0(?: international)?
1 | cc-by-nc-nd-4.0 | noncommercial | creative commons attribution noncommercial no ?deriv(?:ative)?s 4 0(?: international)?
1 | cc-by-nd-4.0 | attribution | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?
2 | lgpl | lesser | (?:gnu )?lesser general public licen[sc]e
2 | agpl | affero | (?:gnu )?affero general public licen[sc]e
2 | gfdl | documentation | (?:gnu )?free documentation licen[sc]e
2 | gpl | general | (?:gnu )?general public licen[sc]e
2 | mpl | mozilla | mozilla public licen[sc]e
2 | epl | eclipse | eclipse public licen[sc]e
2 | eupl | european | european union public licen[sc]e
2 | osl | software | open software licen[sc]e
2 | afl | academic | academic free licen[sc]e
2 | artistic | artistic | (?:clarified )?artistic licen[sc]e
2 | busl | business | business source licen[sc]e
2 | elastic | elastic | elastic licen[sc]e
2 | zpl | zope | zope public licen[sc]e
2 | php | php | php licen[sc]e
2 | ofl | font | (?:sil )?open font licen[sc]e
2 | lppl | latex | latex project public licen[sc]e
2 | isc | isc | isc licen[sc]e
2 | zlib | zlib | zlib(?: libpng)? licen[sc]e
2 | libpng | png | (?:libpng|png reference library) licen[sc]e
2 | unlicense | unlicense | the unlicense
2 | ijg | jpeg | independent jpeg group licen[sc]e
2 | curl | curl | curl licen[sc]e
2 | x11 | x11 | x11 licen[sc]e
2 | postgresql | postgresql | postgresql licen[sc]e
2 | ruby | ruby | ruby licen[sc]e
2 | beerware | beer | beer ?ware licen[sc]e
2 | icu | icu | icu licen[sc]e
2 | unicode | unicode | unicode (?:inc )?licen[sc]e(?: agreement)?
2 | json | json | json licen[sc]e
2 | fsl | functional | functional source licen[sc]e
2 | polyform | polyform | polyform (?:noncommercial|small business|perimeter|shield|strict) licen[sc]e
2 | openrail | rail | (?:big ?science |creative ?ml )?open ?rail(?: m)? licen[sc]e
2 | llama | llama | llama (?:2 |3 |3 1 )?community licen[sc]e
2 | cc-by-sa | attribution | (?:creative commons )?attribution share ?alike(?: licen[sc]e)?
2 | cc-by-nc | attribution | (?:creative commons )?attribution non ?commercial(?: licen[sc]e)?
2 | cc-by-nd | attribution | (?:creative commons )?attribution no ?deriv(?:ative)?s(?: licen[sc]e)?
2 | cc-by | attribution | creative commons attribution(?: licen[sc]e)?
2 | cc0 | cc0 | cc0(?: licen[sc]e| public domain dedication)?
2 | cc0 | zero | creative commons zero
2 | apache-2.0 | apache | (?:http|https) (?:www )?apache org licenses license 2 0(?: txt| html)?
2 | apache-1.1 | apache | (?:http|https) (?:www )?apache org licenses license 1 1
2 | gpl | gnu | (?:http|https) (?:www )?gnu org (?:copyleft|licenses) gpl(?: html| txt)?
2 | gpl-2.0 | gnu | (?:http|https) (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?
2 | gpl-3.0 | gnu | (?:http|https) (?:www )?gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
2 | lgpl | gnu | (?:http|https) (?:www )?gnu org (?:copyleft|licenses) (?:lesser|lgpl)(?: html| txt)?
2 | agpl-3.0 | gnu | (?:http|https) (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
2 | mit | opensource | (?:http|https) (?:www )?opensource org licenses? mit(?: license)?(?: php| html)?
2 | bsd | opensource | (?:http|https) (?:www )?opensource org licenses? bsd license(?: php| html)?
2 | bsd-2-clause | opensource | (?:http|https) (?:www )?opensource org licenses? bsd 2 clause
2 | bsd-3-clause | opensource | (?:http|https) (?:www )?opensource org licenses? bsd 3 clause
2 | isc | opensource | (?:http|https) (?:www )?opensource org licenses? isc
2 | mpl-2.0 | mozilla | (?:http|https) (?:www )?mozilla org (?:en us )?mpl 2 0
2 | mpl-1.1 | mozilla | (?:http|https) (?:www )?mozilla org mpl mpl 1 1(?: html)?
2 | epl | eclipse | (?:http|https) (?:www )?eclipse org legal epl v ?(?:10|20)(?: html)?
2 | bsl-1.0 | boost | (?:http|https) (?:www )?boost org license 1 0(?: txt)?
2 | unlicense | unlicense | (?:http|https) unlicense org
2 | cc0-1.0 | creativecommons | (?:http|https) creativecommons org publicdomain zero 1 0
2 | cc-by-4.0 | creativecommons | (?:http|https) creativecommons org licenses by 4 0
2 | cc-by-3.0 | creativecommons | (?:http|https) creativecommons org licenses by 3 0
2 | cc-by-sa-4.0 | creativecommons | (?:http|https) creativecommons org licenses by sa 4 0
2 | cc-by-sa-3.0 | creativecommons | (?:http|https) creativecommons org licenses by sa 3 0
2 | cc-by-nc-4.0 | creativecommons | (?:http|https) creativecommons org licenses by nc 4 0
2 | cc-by-nc-sa-4.0 | creativecommons | (?:http|https) creativecommons org licenses by nc sa 4 0
2 | cc-by-nc-nd-4.0 | creativecommons | (?:http|https) creativecommons org licenses by nc nd 4 0
2 | cc-by-nd-4.0 | creativecommons | (?:http|https) creativecommons org licenses by nd 4 0
3 | mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
3 | mit | restriction | deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
3 | isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
3 | bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
3 | bsd-3-clause | endorse | neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products
3 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
3 | zlib | altered | altered source versions must be plainly marked as such
3 | gpl | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
3 | lgpl | redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e
3 | apache-2.0 | compliance | you may not use this file except in compliance with the licen[sc]e
3 | mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e
3 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
3 | bsl-1.0 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e
3 | public-domain | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
3 | public-domain | domain | this (?:work|file|software|code) is in the public domain
3 | proprietary | confidential | proprietary and confidential
3 | proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|work)
3 | all-rights-reserved | reserved | all rights reserved
3 | commercial | commercial | commercial licen[sc]e
4 | gpl | gpl | gpl
4 | lgpl | lgpl | lgpl
4 | agpl | agpl | agpl
4 | gfdl | gfdl | gfdl
4 | apache | apache | licen[sc]ed under (?:the )?apache
4 | mit | mit | (?:released|licen[sc]ed|distributed|available) under (?:the )?mit(?: licen[sc]e)?
4 | bsd | bsd | bsd(?: style)? licen[sc]e
4 | bsd | bsd | (?:released|licen[sc]ed|distributed|available) under (?:the )?bsd
4 | mpl | mpl | (?:released|licen[sc]ed|distributed|available) under (?:the )?mpl
4 | cddl | cddl | cddl
4 | eupl | eupl | eupl
4 | odbl | odbl | odbl
4 | cecill | cecill | cecill
4 | cc-by-sa | cc | cc by sa
4 | cc-by-nc | cc | cc by nc
4 | cc-by-nd | cc | cc by nd
4 | cc-by-nc-sa | cc | cc by nc sa
4 | cc-by-nc-nd | cc | cc by nc nd
"""
