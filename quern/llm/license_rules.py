"""The signature rules of the license scan, written by hand.

A line is: labels | keyword | regular expression. The expression is matched against whole lower-cased words with one space
between; the keyword is text that every match of it holds. Of several labels, divided by spaces, all are found. Rules of a
kind are tried in the order in which they stand; the kinds come from the best priority on.
"""

from __future__ import annotations

#: Places that speak of licenses without giving one: what lies within them is not found. They have no label.
NEGATIVE = """
| not licensed under | (?:is |are |was |were )?not licensed under (?:the )?(?:terms of the )?(?:gnu general public license|gnu gpl|gpl|apache license|mit license|bsd license|mozilla public license)
| not covered by | not covered by (?:the )?(?:gnu general public license|gnu gpl|gpl|apache license|mit license|bsd license)
| incompatible with | incompatible with (?:the )?(?:gnu general public license|gnu gpl|gpl|apache license|mit license|mozilla public license)(?: v?[1-3](?: [0-9])?)?
| compatible with | compatible with (?:the )?(?:gnu general public license|gnu gpl|gpl|apache license|mit license|mozilla public license)(?: v?[1-3](?: [0-9])?)?
| instead of the | instead of the (?:gnu general public license|gnu gpl|gpl|apache license|mit license|bsd license|gnu lesser general public license|lgpl)
| formerly | formerly (?:licensed |released |distributed )?under (?:the )?(?:gnu general public license|gnu gpl|gpl|apache license|mit license|bsd license)
| no longer | no longer (?:licensed |released |distributed |available )?under (?:the )?(?:gnu general public license|gnu gpl|gpl|apache license|mit license|bsd license)
| differs from | differs from (?:the )?(?:gnu general public license|gnu gpl|gpl|apache license|mit license|bsd license)
| version of the gnu | the latest version of the gnu general public license is available (?:at|from)
| license plate | (?:mit |apache |bsd )?license plates?(?: number)?
| driver | drivers? s license
| marriage license | marriage license
| license to kill | license to kill
| fishing license | (?:hunting and )?fishing license
| liquor license | liquor license
| how to apply these terms | how to apply these terms to your new (?:programs|libraries)
| why you shouldn t use | why you shouldn t use the lesser gpl for your next library
| all rights reserved for | all rights reserved for (?:guests|members|customers)
| public domain name | public domain names?
| in the public domain of | in the public domain of (?:knowledge|debate|politics|discourse)
"""

#: Grants and terms as license texts and notices have them, each found in the texts of one license alone.
NOTICE = """
gpl | gnu general public license | this program is free software (?:you can|you may) redistribute it and or modify it under the terms of (?:version [123] of )?the gnu general public license(?: as published by the free software foundation)?
gpl | gnu general public license | you should have received a copy of the gnu general public license along with this (?:program|software|file|package)
gpl | gnu general public license | this file is part of [a-z0-9]{1,30} which is released under the gnu general public license
gpl | complete corresponding | accompany it with the complete corresponding machine readable source code
gpl | covered work | to propagate a covered work means to do anything with it that without permission would make you directly or secondarily liable
gpl | freedom to share | designed to (?:take away|guarantee) your freedom to share and change
gpl | gnu general public licence | under the terms of the gnu general public licence
gpl classpath-exception | linking this library | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl gcc-exception | gcc runtime library exception | gcc runtime library exception(?: version 3 1)?
gpl font-exception | embeds this font | as a special exception if you create a document which uses this font and embeds this font
gpl linking-exception | link the code of | as a special exception [a-z0-9 ]{0,60}gives? permission to link the code of
gpl bison-exception | bison parser | you may create a larger work that contains part or all of the bison parser skeleton
lgpl | general public license | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | general public license | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program|file)
lgpl | work that uses the library | a work that uses the library
lgpl | derivative work of the library | such a work in isolation is not a derivative work of the library
lgpl | minimal corresponding source | the minimal corresponding source for a combined work
agpl | affero general public license | it under the terms of the gnu affero general public license
agpl | affero general public license | you should have received a copy of the gnu affero general public license along with this program
agpl | remotely through a computer network | interacting with it remotely through a computer network
gfdl | gnu free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | invariant sections | with no invariant sections no front cover texts and no back cover texts
apache | in compliance with the license | you may not use (?:this file|this work|these files) except in compliance with the license
apache | as is basis without warranties | distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache | governing permissions and limitations | see the license for the specific language governing permissions and limitations under the license
apache | contributor license agreements | licensed to the apache software foundation asf under one or more contributor license agreements
apache | apache software foundation | this product includes software developed by the apache software foundation
apache | apache license | unless required by applicable law or agreed to in writing software distributed under the apache license
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | substantial portions of the software | shall be included in all copies or substantial portions of the software
mit | publish distribute sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | dealings in the software | arising from out of or in connection with the software or the use or other dealings in the software
x11 | dealings in this software | to promote the sale use or other dealings in this software without prior written authorization
mit-0 | without restriction including | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd | reproduce the above copyright notice | redistributions in binary form must reproduce the above copyright notice
bsd | retain the above copyright notice | redistributions of source code must retain the above copyright notice
bsd-3-clause | endorse or promote products | neither the names? of [a-z0-9 ]{1,80}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg?e?ment
0bsd | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
isc | with or without fee | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
mpl | mozilla public license | this source code form is subject to the terms of the mozilla public license
mpl | mozilla public license | the contents of this file are subject to the mozilla public license
mpl | mpl was not distributed | if a copy of the mpl was not distributed with this file you can obtain one at
mpl | incompatible with secondary | this source code form is incompatible with secondary licenses
npl | netscape public license | the contents of this file are subject to the netscape public license
epl | eclipse public license | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | eclipse distribution license | the eclipse distribution license is available at
epl | eclipse foundation | agreement steward the eclipse foundation is the initial agreement steward
cpl | common public license | made available under the terms of the common public license
ipl | ibm public license | under the terms of the ibm public license
cddl | common development and distribution license | subject to the terms of the common development and distribution license
cddl | cddl header | cddl header (?:start|end)
eupl | eupl | licensed under the eupl
eupl | european union public lic | subject to the terms of the european union public licen[cs]e
artistic | artistic control | the copyright holder maintains some semblance of artistic control
artistic | artistic license | under the terms of (?:either )?the artistic license
artistic gpl | terms as perl | (?:it )?under the same terms as perl itself
boost | boost software license | distributed under the boost software license
boost | machine executable object code | solely in the form of machine executable object code generated by a source language processor
zlib | plainly marked as such | altered source versions must be plainly marked as such
zlib | origin of this software | the origin of this software must not be misrepresented
libpng | png reference library | the png reference library is supplied as is
unlicense | unencumbered software | this is free and unencumbered software released into the public domain
wtfpl | what the fuck you want to | you just do what the fuck you want to
wtfpl | what the fuck you want to | do what the fuck you want to public license
beerware | buy me a beer | you can buy me a beer in return
python | psf hereby grants | psf hereby grants licensee a nonexclusive royalty free world wide license
python | cnri open source | cnri open source license agreement
php | php software | this product includes php software
ruby | terms as ruby | under the same terms as ruby
openssl | openssl project | this product includes software developed by the openssl project
ssleay | eric young | this product includes cryptographic software written by eric young
ofl | reserved font name | with reserved font name
ofl | sil open font license | this font software is licensed under the sil open font license
postgresql | university of california | in no event shall the university of california be liable to any party
postgresql | without a written agreement | without fee and without a written agreement is hereby granted
ms-pl | use of the accompanying software | this license governs use of the accompanying software
ms-rl | reciprocal grants | reciprocal grants for any file you distribute
osl | open software license | licensed under the open software license
afl | academic free license | licensed under the academic free license
bsl | non production use | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
bsl | change date | on the change date or the fourth anniversary
sspl | program as a service | offering the program as a service
sspl | server side public license | under the terms of the server side public license
elastic | hosted or managed service | provide the software to third parties as a hosted or managed service
commons-clause | commons clause | the software is provided to you subject to the commons clause
cecill | cecill | governed by the cecill(?: b| c)? license
odbl | open database license | made available under the open database license
odc-by | open data commons attribution license | made available under the open data commons attribution license
pddl | public domain dedication and license | made available under the public domain dedication and license
ogl | open government licence | contains public sector information licensed under the open government licence
etalab | licence ouverte | licence ouverte(?: open licence)?
cc0 | related or neighboring rights | waived all copyright and related or neighboring rights
cc0 | no rights reserved | (?:cc0 )?no rights reserved
cc-by | creative commons attribution | (?:is |are )?licensed under (?:a |the )?creative commons attribution (?:[1-4] [05] )?(?:generic |international |unported )?licen[cs]e
cc-by-sa | creative commons attribution share | (?:is |are )?licensed under (?:a |the )?creative commons attribution share ?alike
cc-by-nc | creative commons attribution non | (?:is |are )?licensed under (?:a |the )?creative commons attribution non ?commercial
cc-by-nd | creative commons attribution no | (?:is |are )?licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa | creative commons attribution non | (?:is |are )?licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | creative commons attribution non | (?:is |are )?licensed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-sa | text is available under | text is available under the creative commons attribution share ?alike license
cc-by-sa gfdl | cc by sa and gfdl | (?:available |dual licensed )?under cc by sa and gfdl
public-domain | public domain | (?:has been |is hereby |hereby |i hereby )?(?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | no copyright is claimed | no copyright is claimed
public-domain | work of the united states government | (?:as )?a work of the united states government
proprietary | proprietary and confidential | proprietary and confidential
proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | trade secrets | contains (?:confidential information and )?trade secrets (?:of|and)
proprietary | without express written permission | may not be (?:reproduced|copied|distributed|reproduced or distributed) without express written permission
proprietary | end user license agreement | (?:this )?end user license agreement
proprietary | for personal use only | for personal use only not for (?:resale|redistribution|commercial use)
"""

#: Choices of licenses.
DUAL = """
apache mit | apache license version 2 0 | licensed under either of (?:the )?apache license version 2 0 [a-z0-9 ]{0,120}mit license
apache mit | mit or apache 2 0 | (?:licensed under )?mit or apache 2 0
apache mit | apache 2 0 or mit | (?:licensed under )?apache 2 0 or mit
apache mit | mit apache 2 0 | dual licensed (?:under )?mit apache 2 0
gpl mit | mit and gpl | (?:dual licensed under |licensed under )(?:the )?mit and gpl(?: licenses)?
gpl mit | mit or gpl | (?:dual licensed under |licensed under )(?:the )?mit or gpl(?: version 2)?(?: licenses)?
gpl mpl lgpl | mpl 1 1 gpl 2 0 lgpl 2 1 | mpl 1 1 gpl 2 0 lgpl 2 1
gpl bsd | bsd | dual licensed under (?:the )?(?:gpl|gnu gpl|gpl v2) and (?:the )?(?:3 clause )?bsd(?: license)?
gpl artistic | artistic | (?:under )?either (?:a )?the gnu general public license [a-z0-9 ]{0,120}or b? ?the artistic license
gpl cddl | cddl | cddl (?:and|or|1 0|1 1) gpl(?: ?v?2)?(?: with classpath exception)?
epl lgpl | epl | dual licensed under (?:the )?epl (?:v?1 0 )?and (?:the )?lgpl(?: 2 1)?
epl apache | epl 2 0 or apache 2 0 | epl 2 0 or apache 2 0
gpl proprietary | commercial license | (?:available|offered) under (?:the )?(?:gpl|gnu gpl|agpl) or (?:a )?commercial license
"""

#: Identifiers, and headers that name a version.
IDENTIFIER = """
gpl | spdx license identifier gpl | spdx license identifier gpl [123](?: 0)?(?: only| or later)?
lgpl | spdx license identifier lgpl | spdx license identifier lgpl [23](?: [01])?(?: only| or later)?
agpl | spdx license identifier agpl | spdx license identifier agpl [13](?: 0)?(?: only| or later)?
gfdl | spdx license identifier gfdl | spdx license identifier gfdl 1 [123](?: only| or later)?
apache | spdx license identifier apache | spdx license identifier apache [12] [01]
mit-0 | spdx license identifier mit 0 | spdx license identifier mit 0
mit | spdx license identifier mit | spdx license identifier mit
x11 | spdx license identifier x11 | spdx license identifier x11
0bsd | spdx license identifier 0bsd | spdx license identifier 0bsd
bsd | spdx license identifier bsd | spdx license identifier bsd [1-4] clause(?: clear| patent)?
isc | spdx license identifier isc | spdx license identifier isc
mpl | spdx license identifier mpl | spdx license identifier mpl [12] [01]
epl | spdx license identifier epl | spdx license identifier epl [12] 0
cddl | spdx license identifier cddl | spdx license identifier cddl 1 [01]
cpl | spdx license identifier cpl | spdx license identifier cpl 1 0
eupl | spdx license identifier eupl | spdx license identifier eupl 1 [012]
artistic | spdx license identifier artistic | spdx license identifier artistic [12] 0
boost | spdx license identifier bsl | spdx license identifier bsl 1 0
zlib | spdx license identifier zlib | spdx license identifier zlib
unlicense | spdx license identifier unlicense | spdx license identifier unlicense
wtfpl | spdx license identifier wtfpl | spdx license identifier wtfpl
python | spdx license identifier p | spdx license identifier (?:psf|python) 2 0(?: 1)?
php | spdx license identifier php | spdx license identifier php 3 01?
openssl | spdx license identifier openssl | spdx license identifier openssl
ofl | spdx license identifier ofl | spdx license identifier ofl 1 [01]
postgresql | spdx license identifier postgresql | spdx license identifier postgresql
ms-pl | spdx license identifier ms pl | spdx license identifier ms pl
ms-rl | spdx license identifier ms rl | spdx license identifier ms rl
osl | spdx license identifier osl | spdx license identifier osl [123] [01]
afl | spdx license identifier afl | spdx license identifier afl [123] [012]
bsl | spdx license identifier busl | spdx license identifier busl 1 1
sspl | spdx license identifier sspl | spdx license identifier sspl 1 0
elastic | spdx license identifier elastic | spdx license identifier elastic 2 0
cecill | spdx license identifier cecill | spdx license identifier cecill(?: b| c| 1 0| 1 1| 2 0| 2 1)
odbl | spdx license identifier odbl | spdx license identifier odbl 1 0
odc-by | spdx license identifier odc by | spdx license identifier odc by 1 0
pddl | spdx license identifier pddl | spdx license identifier pddl 1 0
ogl | spdx license identifier ogl | spdx license identifier ogl(?: uk)? [123] 0
cc0 | spdx license identifier cc0 | spdx license identifier cc0 1 0
cc-by | spdx license identifier cc by | spdx license identifier cc by [1-4] [05]
cc-by-sa | spdx license identifier cc by sa | spdx license identifier cc by sa [1-4] [05]
cc-by-nc | spdx license identifier cc by nc | spdx license identifier cc by nc [1-4] [05]
cc-by-nd | spdx license identifier cc by nd | spdx license identifier cc by nd [1-4] [05]
cc-by-nc-sa | spdx license identifier cc by nc sa | spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd | spdx license identifier cc by nc nd | spdx license identifier cc by nc nd [1-4] [05]
apache mit | spdx license identifier | spdx license identifier (?:apache 2 0 or mit|mit or apache 2 0)
gpl mit | spdx license identifier | spdx license identifier (?:gpl 2 0 (?:only |or later )?or mit|mit or gpl 2 0(?: only| or later)?)
gpl bsd | spdx license identifier | spdx license identifier (?:gpl 2 0 (?:only |or later )?or bsd [23] clause|bsd [23] clause or gpl 2 0(?: only| or later)?)
gpl linux-syscall-note | linux syscall note | spdx license identifier gpl 2 0 (?:only |or later )?with linux syscall note
proprietary | licenseref | spdx license identifier licenseref proprietary
cc-by | creativecommons org licenses by | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons org licenses by sa | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | creativecommons org licenses by nc | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | creativecommons org licenses by nd | creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd [1-4] [05]
cc0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
public-domain | creativecommons org publicdomain mark | creativecommons org publicdomain mark 1 0
apache | apache org licenses license 2 0 | (?:www )?apache org licenses license 2 0
gpl | gnu org licenses gpl | (?:www )?gnu org licenses gpl(?: [123] 0)?
lgpl | gnu org licenses lgpl | (?:www )?gnu org licenses lgpl(?: [23] [01])?
agpl | gnu org licenses agpl | (?:www )?gnu org licenses agpl(?: 3 0)?
mpl | mozilla org mpl | (?:www )?mozilla org mpl(?: 2 0| 1 1)?
mit | opensource org licenses mit | opensource org licenses mit(?: license)?
bsd | opensource org licenses bsd | opensource org licenses bsd [23] clause
epl | eclipse org legal epl | (?:www )?eclipse org legal epl v?[12]0?(?: 0)?
ofl | scripts sil org ofl | scripts sil org ofl
"""

#: Names with versions.
VERSIONED = """
gpl | gnu general public license | gnu general public license(?: gpl)?,?(?: as published by the free software foundation)?(?: either)? (?:version|v) ?[123](?: 0)?(?: of the license)?(?: or (?:at your option )?(?:any )?later(?: version)?)?
gpl | gnu gpl | gnu gpl ?(?:version |v )?v?[123](?: 0)?(?: or (?:any )?later(?: version)?)?
gpl | gpl | gpl ?(?:version |v )?v?[23](?: 0)?(?: only| or later)?
gpl | gplv | gplv[123]
lgpl | general public license | gnu (?:lesser|library) general public license(?: lgpl)? (?:version|v) ?[23](?: [01])?(?: or (?:any )?later(?: version)?)?
lgpl | lgpl | lgpl ?(?:version |v )?v?[23](?: [01])?(?: only| or later)?
lgpl | lgplv | lgplv[23](?: 1)?
agpl | affero general public license | (?:gnu )?affero general public license(?: agpl)? (?:version|v) ?[13](?: 0)?
agpl | agpl | agpl ?(?:version |v )?v?[13](?: 0)?(?: only| or later)?
agpl | agplv | agplv[13]
gfdl | gnu free documentation license | gnu free documentation license version 1 [123]
gfdl | gfdl | gfdl 1 [123]
apache | apache | apache(?: software)? license,? ?(?:version|v)? ?v?[12] [01]
apache | apache 2 0 | apache 2 0(?: license)?
apache | asl 2 0 | asl 2 0
apache | alv2 | alv2
bsd-2-clause | bsd | (?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e|bsd (?:2|two) clause(?: licen[cs]e)?
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd licen[cs]e|bsd (?:3|three) clause(?: licen[cs]e)?
bsd-4-clause | bsd | (?:original|old|4 clause|four clause) bsd licen[cs]e|bsd (?:4|four) clause(?: licen[cs]e)?
mpl | mozilla public license | mozilla public license(?: mpl)?,? ?(?:version|v)? ?v?[12] [01]
mpl | mpl | mpl ?v?[12] [01]
mpl | mplv | mplv[12](?: [01])?
epl | eclipse public license | eclipse public license ?(?:version|v)? ?v?[12](?: 0)?
epl | epl | epl ?v?[12] 0
cddl | common development and distribution license | common development and distribution license(?: cddl)? ?(?:version|v)? ?1 [01]
cddl | cddl | cddl ?v?1 [01]
cpl | common public license | common public license ?(?:version|v)? ?1 0
eupl | european union public lic | european union public licen[cs]e ?(?:version|v)? ?1 [012]
eupl | eupl | eupl ?v?1 [012]
artistic | artistic license | artistic license ?(?:version|v)? ?[12] 0
boost | boost software license | boost software license(?: version)? 1 0
wtfpl | wtfpl | wtfpl ?(?:version|v)? ?2
python | python software foundation license | python software foundation license(?: version)? [23](?: [0-9])?
php | php license | php license(?: version)? 3 01?
ofl | open font license | (?:sil )?open font license(?: version)? 1 [01]
osl | open software license | open software license(?: version)? [123] [01]
afl | academic free license | academic free license(?: version)? [123] [012]
bsl | business source license | business source license(?: version)? 1 1
sspl | server side public license | server side public license(?: version)? 1
elastic | elastic license | elastic license ?(?:version)? ?2 0
odbl | open database license | open database license(?: odbl)? ?v?1 0
ogl | open government licence | open government licence ?(?:version|v)? ?v?[123] 0
cc0 | cc0 1 0 | cc0 1 0(?: universal)?
cc-by | cc by | cc by [1-4] [05]
cc-by-sa | cc by sa | cc by sa [1-4] [05]
cc-by-nc | cc by nc | cc by nc [1-4] [05]
cc-by-nd | cc by nd | cc by nd [1-4] [05]
cc-by-nc-sa | cc by nc sa | cc by nc sa [1-4] [05]
cc-by-nc-nd | cc by nc nd | cc by nc nd [1-4] [05]
cc-by | creative commons attribution | creative commons attribution [1-4] [05]
cc-by-sa | creative commons attribution share | creative commons attribution share ?alike [1-4] [05]
cc-by-nc | creative commons attribution non | creative commons attribution non ?commercial [1-4] [05]
"""

#: Grants by a name.
NAMED = """
gpl | gnu general public license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?gnu general public license
gpl | gpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?gpl
lgpl | lgpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?lgpl
agpl | agpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?agpl
apache | apache | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache(?: software)? license
mit | licen | (?:licensed|released|distributed|available|published|provided) under (?:the |an? )?(?:terms of the )?(?:expat |x11 )?mit(?: style)? licen[cs]e
bsd | bsd | (?:licensed|released|distributed|available|published|provided) under (?:the |an? )?(?:terms of the )?bsd(?: style)? licen[cs]e
isc | isc license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?isc license
mpl | mozilla public license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?mozilla public license
epl | eclipse public license | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?eclipse public license
zlib | zlib | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?zlib(?: libpng)? license
unlicense | unlicense | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?unlicense
cc0 | cc0 | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?cc0
cc0 | cc zero | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?cc zero
cc-by | cc by | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?cc by(?: licen[cs]e)?
cc-by-sa | cc by sa | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?cc by sa(?: licen[cs]e)?
cc-by-nc | cc by nc | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?cc by nc(?: licen[cs]e)?
public-domain | public domain | (?:this (?:work|file|code|software|text) )?is in the public domain
proprietary | proprietary license | (?:licensed|released|distributed|available|published|provided) under (?:a )?proprietary license
"""

#: Names alone.
MENTION = """
gpl | gnu general public license | gnu general public license
gpl | gnu gpl | gnu gpl
gpl | general public license | general public license
lgpl | lesser general public license | gnu lesser general public license|lesser general public license
lgpl | library general public license | gnu library general public license|library general public license
lgpl | lgpl | gnu lgpl|lgpl
agpl | affero general public license | gnu affero general public license|affero general public license
agpl | agpl | gnu agpl|agpl
gfdl | gnu free documentation license | gnu free documentation license
gfdl | gfdl | gnu gfdl|gfdl
apache | apache | apache(?: software)? license
mit | mit license | mit license
mit | expat license | expat license
x11 | x11 license | x11 license
bsd | bsd | bsd(?: style)? licen[cs]e
isc | isc license | isc license
mpl | mozilla public license | mozilla public license
npl | netscape public license | netscape public license
epl | eclipse public license | eclipse public license
cpl | common public license | common public license
ipl | ibm public license | ibm public license
cddl | common development and distribution license | common development and distribution license
eupl | european union public lic | european union public licen[cs]e
artistic | artistic license | (?:perl )?artistic license
boost | boost software license | boost software license
zlib | zlib | zlib(?: libpng)? license
unlicense | the unlicense | the unlicense
wtfpl | wtfpl | wtfpl
beerware | beerware | beerware(?: license)?
python | python software foundation license | python software foundation license
python | psf license | psf license
php | php license | php license
ruby | ruby license | ruby license
openssl | openssl license | openssl license
ofl | open font license | (?:sil )?open font license
postgresql | postgresql license | postgresql license
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
osl | open software license | open software license
afl | academic free license | academic free license
bsl | business source license | business source license
sspl | server side public license | server side public license
elastic | elastic license | elastic license
commons-clause | commons clause | commons clause
cecill | cecill | cecill(?: b| c)?(?: free software)? license
odbl | open database license | open database license
odbl | odbl | odbl
odc-by | open data commons attribution license | open data commons attribution license
pddl | public domain dedication and license | public domain dedication and license
ogl | open government licence | open government licence
cc0 | creative commons zero | creative commons zero
cc0 | cc0 | cc0
cc-by | creative commons attribution | creative commons attribution
cc-by-sa | creative commons attribution share | creative commons attribution share ?alike
cc-by-nc | creative commons attribution non | creative commons attribution non ?commercial
cc-by-nd | creative commons attribution no | creative commons attribution no ?deriv(?:ative)?s
cc-by-nc-sa | creative commons attribution non | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | creative commons attribution non | creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by | cc by | cc by
cc-by-sa | cc by sa | cc by sa
cc-by-nc | cc by nc | cc by nc
cc-by-nd | cc by nd | cc by nd
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc-nd | cc by nc nd | cc by nc nd
public-domain | in the public domain | in the public domain
proprietary | all rights reserved | all rights reserved
"""

#: Kinds from the best priority on, with how sure a detection of the kind is.
KINDS = {"negative": (NEGATIVE, 0.0), "dual": (DUAL, 0.97), "notice": (NOTICE, 0.95), "identifier": (IDENTIFIER, 0.95), "versioned": (VERSIONED, 0.9), "named": (NAMED, 0.7), "mention": (MENTION, 0.4)}
