"""License signatures: hand-written patterns, expanded into ordered rules.

Java regular expressions, case-insensitive for ASCII. Each entry of SIGNATURES
gives the label, the pattern of its identifier, the pattern of its written name
and the pattern of its address; `rules()` expands an entry into tag, notice,
name and address rules. TEXTS are sentences of license texts, a rule each.

Keywords are derived from the patterns (`weftline.llm.keywords`): every match
holds a keyword of each cut of its rule, so a gate can't lose a match. No pattern
repeats a group without bound, as Java's matcher would recurse once a turn.
"""

from __future__ import annotations

from functools import lru_cache

from weftline.llm.keywords import cuts

V = r"[\s,]*(?:version|ver\.?|v\.?)?\s*"

# (label, identifier, name, address)
SIGNATURES: tuple[tuple[str, str, str, str | None], ...] = (
    ("mit", r"MIT", r"(?:MIT|Expat)\s+licen[cs]e", r"opensource\.org/licenses/mit"),
    ("mit-0", r"MIT-0", r"MIT\s+no\s+attribution", r"opensource\.org/licenses/mit-0"),
    ("apache-1", r"Apache-1\.[01]", rf"apache(?:\s+software)?\s+licen[cs]e{V}1\.[01]", r"apache\.org/licenses/LICENSE-1\.[01]"),
    ("apache-2", r"Apache-2\.0", rf"apache(?:\s+software)?\s+licen[cs]e{V}2(?:\.0)?(?!\d)", r"apache\.org/licenses/LICENSE-2\.0"),
    ("bsd-2", r"BSD-2-Clause(?:-\w+)?", r"(?:2|two)[ -]clause\s+BSD|BSD\s+(?:2|two)[ -]clause|simplified\s+BSD|FreeBSD\s+licen[cs]e", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3", r"BSD-3-Clause(?:-\w+)?", r"(?:3|three)[ -]clause\s+BSD|BSD\s+(?:3|three)[ -]clause|(?:new|revised|modified)\s+BSD", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4", r"BSD-4-Clause(?:-\w+)?", r"(?:4|four)[ -]clause\s+BSD|BSD\s+(?:4|four)[ -]clause|original\s+BSD", None),
    ("bsd-0", r"0BSD", r"zero[ -]clause\s+BSD|BSD\s+zero[ -]clause", r"opensource\.org/licenses/0bsd"),
    ("bsd", r"BSD", r"BSD(?:-style)?\s+licen[cs]e", None),
    ("isc", r"ISC", r"ISC\s+licen[cs]e", r"opensource\.org/licenses/isc"),
    ("gpl-1", r"GPL-1\.0(?:-only|-or-later|\+)?", rf"(?:GNU\s+)?general\s+public\s+licen[cs]e{V}1(?:\.0)?(?![\d.])|GPL[ -]?v?1(?![\d.])", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1"),
    ("gpl-2", r"GPL-2\.0(?:-only|-or-later|\+)?", rf"(?:GNU\s+)?general\s+public\s+licen[cs]e{V}2(?:\.0)?(?![\d.]\d)|GPL[ -]?v?2(?![\d.]\d)", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2"),
    ("gpl-3", r"GPL-3\.0(?:-only|-or-later|\+)?", rf"(?:GNU\s+)?general\s+public\s+licen[cs]e{V}3(?:\.0)?(?![\d.]\d)|GPL[ -]?v?3(?![\d.]\d)", r"gnu\.org/licenses/gpl-3"),
    ("gpl", r"GPL", r"GNU\s+(?:general\s+public\s+licen[cs]e|GPL)", r"gnu\.org/licenses/gpl(?!-)"),
    ("lgpl-2", r"LGPL-2\.0(?:-only|-or-later|\+)?", rf"(?:library|lesser)\s+general\s+public\s+licen[cs]e{V}2(?:\.0)?(?![\d.])|LGPL[ -]?v?2(?![\d.])", None),
    ("lgpl-2.1", r"LGPL-2\.1(?:-only|-or-later|\+)?", rf"lesser\s+general\s+public\s+licen[cs]e{V}2\.1|LGPL[ -]?v?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3", r"LGPL-3\.0(?:-only|-or-later|\+)?", rf"lesser\s+general\s+public\s+licen[cs]e{V}3|LGPL[ -]?v?3", r"gnu\.org/licenses/lgpl-3"),
    ("agpl-3", r"AGPL-3\.0(?:-only|-or-later|\+)?", rf"affero\s+general\s+public\s+licen[cs]e(?:{V}3)?|AGPL[ -]?v?3", r"gnu\.org/licenses/agpl-3"),
    ("gfdl", r"GFDL-1\.[1-3][\w-]*", r"GNU\s+free\s+documentation\s+licen[cs]e", r"gnu\.org/licenses/fdl"),
    ("mpl-1", r"MPL-1\.[01]", rf"mozilla\s+public\s+licen[cs]e{V}1\.[01]|MPL[ -]?1\.[01]", r"mozilla\.org/MPL/1\.1"),
    ("mpl-2", r"MPL-2\.0", rf"mozilla\s+public\s+licen[cs]e(?:{V}2(?:\.0)?)?|MPL[ -]?2(?:\.0)?", r"mozilla\.org/(?:en-US/)?MPL/2\.0"),
    ("epl-1", r"EPL-1\.0", rf"eclipse\s+public\s+licen[cs]e{V}1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2", r"EPL-2\.0", rf"eclipse\s+public\s+licen[cs]e{V}2(?:\.0)?", r"eclipse\.org/legal/epl-(?:2\.0|v20)"),
    ("cddl", r"CDDL-1\.[01]", r"common\s+development\s+and\s+distribution\s+licen[cs]e", r"opensource\.org/licenses/cddl"),
    ("cpl", r"CPL-1\.0", rf"common\s+public\s+licen[cs]e(?:{V}1\.0)?", None),
    ("artistic-1", r"Artistic-1\.0(?:-\w+)?", rf"artistic\s+licen[cs]e{V}1(?:\.0)?", None),
    ("artistic-2", r"Artistic-2\.0", rf"artistic\s+licen[cs]e{V}2(?:\.0)?", r"opensource\.org/licenses/artistic-license-2\.0"),
    ("bsl-1", r"BSL-1\.0", r"boost\s+software\s+licen[cs]e", r"boost\.org/LICENSE_1_0"),
    ("busl", r"BUSL-1\.1", r"business\s+source\s+licen[cs]e", r"mariadb\.com/bsl11"),
    ("zlib", r"Zlib", r"zlib(?:/libpng)?\s+licen[cs]e", r"zlib\.net/zlib_license"),
    ("libpng", r"libpng(?:-2\.0)?", r"libpng\s+licen[cs]e", None),
    ("unlicense", r"Unlicense", r"the\s+unlicense", r"unlicense\.org"),
    ("wtfpl", r"WTFPL", r"do\s+what\s+the\s+f\w+\s+you\s+want", r"wtfpl\.net"),
    ("cc0", r"CC0-1\.0", r"CC0(?:\s+1\.0)?|creative\s+commons\s+zero", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", r"CC-BY-NC-ND-\d\.\d", r"CC[ -]BY-NC-ND|attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", r"CC-BY-NC-SA-\d\.\d", r"CC[ -]BY-NC-SA|attribution[- ]non-?commercial[- ]share-?alike", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", r"CC-BY-NC-\d\.\d", r"CC[ -]BY[ -]NC(?![ -](?:SA|ND))|attribution[- ]non-?commercial(?![- ](?:share|no))", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", r"CC-BY-ND-\d\.\d", r"CC[ -]BY-ND|attribution[- ]no-?deriv(?:ative)?s?", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", r"CC-BY-SA-\d\.\d", r"CC[ -]BY-SA|attribution[- ]share-?alike", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", r"CC-BY-\d\.\d", r"CC[ -]BY(?![ -](?:NC|ND|SA))(?:[ -]\d\.\d)?|creative\s+commons\s+attribution(?![- ](?:non|no|share))", r"creativecommons\.org/licenses/by/"),
    ("odbl", r"ODbL-1\.0", r"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[cs]e", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", r"ODC-By-1\.0", r"open\s+data\s+commons\s+attribution", r"opendatacommons\.org/licenses/by"),
    ("pddl", r"PDDL-1\.0", r"public\s+domain\s+dedication\s+and\s+licen[cs]e", r"opendatacommons\.org/licenses/pddl"),
    ("public-domain", r"LicenseRef-public-domain", r"(?:in|into|to)\s+the\s+public\s+domain|public\s+domain\s+work", r"creativecommons\.org/publicdomain/mark"),
    ("eupl", r"EUPL-1\.[0-2]", r"european\s+union\s+public\s+licen[cs]e", r"joinup\.ec\.europa\.eu/[\w/-]*eupl"),
    ("ofl", r"OFL-1\.[01](?:-\w+)?", r"SIL\s+open\s+font\s+licen[cs]e", r"scripts\.sil\.org/OFL"),
    ("postgresql", r"PostgreSQL", r"postgresql\s+licen[cs]e", r"opensource\.org/licenses/postgresql"),
    ("python", r"(?:Python|PSF)-2\.0", r"python\s+software\s+foundation\s+licen[cs]e|PSF\s+licen[cs]e", r"docs\.python\.org/[\w./]*license"),
    ("ruby", r"Ruby", r"ruby(?:'s)?\s+licen[cs]e", None),
    ("php", r"PHP-3\.0[01]?", rf"PHP\s+licen[cs]e(?:{V}3\.0[01]?)?", r"php\.net/license"),
    ("w3c", r"W3C(?:-\d+)?", r"W3C\s+software\s+(?:notice|licen[cs]e)", r"w3\.org/Consortium/Legal"),
    ("openssl", r"OpenSSL", r"openssl\s+licen[cs]e", r"openssl\.org/source/license"),
    ("ncsa", r"NCSA", r"(?:university\s+of\s+illinois|NCSA)\s+open\s+source\s+licen[cs]e", r"opensource\.org/licenses/ncsa"),
    ("ms-pl", r"MS-PL", r"microsoft\s+public\s+licen[cs]e", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", r"MS-RL", r"microsoft\s+reciprocal\s+licen[cs]e", r"opensource\.org/licenses/ms-rl"),
    ("sspl", r"SSPL-1\.0", r"server\s+side\s+public\s+licen[cs]e", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2", r"Elastic-2\.0", rf"elastic\s+licen[cs]e(?:{V}2(?:\.0)?)?", r"elastic\.co/licensing/elastic-license"),
    ("openrail", r"(?:CreativeML-)?Open-?RAIL[\w-]*", r"(?:creativeml\s+)?open\s*rail(?:[ -][ms+]+)?\s+licen[cs]e", None),
    ("afl-3", r"AFL-3\.0", rf"academic\s+free\s+licen[cs]e(?:{V}3(?:\.0)?)?", r"opensource\.org/licenses/afl-3"),
    ("osl-3", r"OSL-3\.0", rf"open\s+software\s+licen[cs]e(?:{V}3(?:\.0)?)?", r"opensource\.org/licenses/osl-3"),
    ("upl", r"UPL-1\.0", r"universal\s+permissive\s+licen[cs]e", r"opensource\.org/licenses/upl"),
    ("mulan-2", r"MulanPSL-2\.0", rf"mulan\s+(?:permissive\s+software\s+licen[cs]e|PSL)(?:{V}2)?", r"license\.coscl\.org\.cn/MulanPSL2"),
    ("apache", r"Apache", r"apache(?:\s+software)?\s+licen[cs]e(?![\s,]*(?:version|ver\.?|v\.?)?\s*[12])", r"apache\.org/licenses(?!/LICENSE-)"),
    ("lgpl", r"LGPL", r"GNU\s+(?:lesser\s+general\s+public\s+licen[cs]e|LGPL)(?!\s*v?\d)", r"gnu\.org/licenses/lgpl(?!-)"),
    ("agpl", r"AGPL", r"GNU\s+AGPL(?!\s*v?\d)", r"gnu\.org/licenses/agpl(?!-)"),
    ("mpl", r"MPL", r"mozilla\s+public\s+licen[cs]e(?![\s,]*(?:version|ver\.?|v\.?)?\s*[12])", r"mozilla\.org/MPL/?(?![\w/])"),
    ("aal", r"AAL", r"attribution\s+assurance\s+licen[cs]e", r"opensource\.org/licenses/attribution"),
    ("adobe", r"Adobe-\w+", r"adobe\s+systems\s+incorporated\s+source\s+code\s+licen[cs]e", None),
    ("aladdin", r"Aladdin", r"aladdin\s+free\s+public\s+licen[cs]e", None),
    ("apsl", r"APSL-[12]\.\d", r"apple\s+public\s+source\s+licen[cs]e", r"opensource\.org/licenses/apsl"),
    ("beerware", r"Beerware", r"beer-?ware\s+licen[cs]e", None),
    ("blueoak", r"BlueOak-1\.0\.0", r"blue\s+oak\s+model\s+licen[cs]e", r"blueoakcouncil\.org/license"),
    ("bsd-1", r"BSD-1-Clause", r"(?:1|one)[ -]clause\s+BSD|BSD\s+(?:1|one)[ -]clause", None),
    ("bsd-patent", r"BSD-2-Clause-Patent", r"BSD\s?\+\s?patent", None),
    ("cecill", r"CECILL-(?:[12]\.[01]|[BC])", r"CeCILL(?:-[BC])?\s+(?:free\s+software\s+)?licen[cs]e", r"cecill\.info/licences"),
    ("cern-ohl", r"CERN-OHL-[\w.-]+", r"CERN\s+open\s+hardware\s+licen[cs]e", r"ohwr\.org/[\w/-]*cernohl"),
    ("clear-bsd", r"BSD-3-Clause-Clear", r"clear\s+BSD\s+licen[cs]e", None),
    ("copyfree", r"LicenseRef-copyfree", r"copyfree\s+(?:open\s+)?innovation\s+licen[cs]e", None),
    ("cua", r"CUA-OPL-1\.0", r"CUA\s+office\s+public\s+licen[cs]e", r"opensource\.org/licenses/cua"),
    ("curl", r"curl", r"curl\s+licen[cs]e", r"curl\.(?:se|haxx\.se)/docs/copyright"),
    ("dbad", r"DBAD", r"don'?t\s+be\s+a\s+dick\s+public\s+licen[cs]e", None),
    ("ecl", r"ECL-[12]\.0", r"educational\s+community\s+licen[cs]e", r"opensource\.org/licenses/ecl"),
    ("efl", r"EFL-[12]\.0", r"eiffel\s+forum\s+licen[cs]e", r"opensource\.org/licenses/ver2_eiffel"),
    ("entessa", r"Entessa", r"entessa\s+public\s+licen[cs]e", r"opensource\.org/licenses/entessa"),
    ("erlang", r"ErlPL-1\.1", r"erlang\s+public\s+licen[cs]e", None),
    ("etalab", r"etalab-2\.0", r"licence\s+ouverte|etalab\s+open\s+licen[cs]e", r"etalab\.gouv\.fr/[\w/-]*licence"),
    ("fair", r"Fair", r"fair\s+licen[cs]e", r"opensource\.org/licenses/fair"),
    ("frameworx", r"Frameworx-1\.0", r"frameworx\s+(?:open\s+)?licen[cs]e", None),
    ("freetype", r"FTL", r"freetype\s+(?:project\s+)?licen[cs]e", r"freetype\.org/[\w./-]*licen"),
    ("giftware", r"Giftware", r"giftware\s+licen[cs]e", None),
    ("hippocratic", r"Hippocratic-2\.1", r"hippocratic\s+licen[cs]e", r"firstdonoharm\.dev"),
    ("hpnd", r"HPND", r"historical\s+permission\s+notice\s+and\s+disclaimer", r"opensource\.org/licenses/historical"),
    ("icu", r"ICU", r"ICU\s+licen[cs]e", None),
    ("ijg", r"IJG", r"independent\s+jpeg\s+group\s+licen[cs]e", None),
    ("imagemagick", r"ImageMagick", r"imagemagick\s+licen[cs]e", r"imagemagick\.org/script/license"),
    ("intel", r"Intel", r"intel\s+(?:open\s+source|simplified\s+software)\s+licen[cs]e", None),
    ("ipa", r"IPA", r"IPA\s+font\s+licen[cs]e", r"opensource\.org/licenses/ipafont"),
    ("ipl", r"IPL-1\.0", r"IBM\s+public\s+licen[cs]e", r"opensource\.org/licenses/ibmpl"),
    ("jasper", r"JasPer-2\.0", r"jasper\s+licen[cs]e", None),
    ("json", r"JSON", r"JSON\s+licen[cs]e", r"json\.org/license"),
    ("latex", r"LPPL-1\.\d[abc]?", r"latex\s+project\s+public\s+licen[cs]e", r"latex-project\.org/lppl"),
    ("liliq", r"LiLiQ-[\w.-]+", r"licence\s+libre\s+du\s+qu[eé]bec", r"forge\.gouv\.qc\.ca/[\w/-]*licence"),
    ("llama", r"LicenseRef-llama-\d", r"llama\s+[\d.]+\s+community\s+licen[cs]e", r"llama\.meta\.com/[\w/-]*license"),
    ("lucent", r"LPL-1\.0[2]?", r"lucent\s+public\s+licen[cs]e", r"opensource\.org/licenses/lucent"),
    ("miros", r"MirOS", r"miros\s+licen[cs]e", r"opensource\.org/licenses/miros"),
    ("motosoto", r"Motosoto", r"motosoto\s+open\s+source\s+licen[cs]e", None),
    ("nasa", r"NASA-1\.3", r"nasa\s+open\s+source\s+agreement", r"opensource\.org/licenses/nasa"),
    ("naumen", r"Naumen", r"naumen\s+public\s+licen[cs]e", r"opensource\.org/licenses/naumen"),
    ("netscape", r"NPL-1\.[01]", r"netscape\s+public\s+licen[cs]e", r"mozilla\.org/(?:NPL|MPL/NPL)"),
    ("nokia", r"Nokia", r"nokia\s+open\s+source\s+licen[cs]e", r"opensource\.org/licenses/nokia"),
    ("nposl", r"NPOSL-3\.0", r"non-profit\s+open\s+software\s+licen[cs]e", r"opensource\.org/licenses/nposl"),
    ("ntp", r"NTP", r"NTP\s+licen[cs]e", r"opensource\.org/licenses/ntp"),
    ("oclc", r"OCLC-2\.0", r"OCLC\s+research\s+public\s+licen[cs]e", r"opensource\.org/licenses/oclc"),
    ("ogl-uk", r"OGL-UK-[123]\.0", r"open\s+government\s+licen[cs]e", r"nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("oldap", r"OLDAP-[\d.]+", r"openldap\s+public\s+licen[cs]e", r"openldap\.org/software/release/license"),
    ("opl", r"OPUBL-1\.0", r"open\s+publication\s+licen[cs]e", r"opencontent\.org/openpub"),
    ("oset", r"OSET-PL-2\.1", r"OSET\s+(?:foundation\s+)?public\s+licen[cs]e", None),
    ("parity", r"Parity-[67]\.0\.0", r"parity\s+public\s+licen[cs]e", r"paritylicense\.com"),
    ("polyform", r"PolyForm-[\w.-]+", r"polyform\s+(?:noncommercial|small\s+business|shield|strict|perimeter|internal\s+use)\s+licen[cs]e", r"polyformproject\.org/licenses"),
    ("qpl", r"QPL-1\.0", r"Q\s+public\s+licen[cs]e", r"opensource\.org/licenses/qtpl"),
    ("realnetworks", r"RPSL-1\.0", r"realnetworks\s+public\s+source\s+licen[cs]e", r"opensource\.org/licenses/real"),
    ("rpl", r"RPL-1\.[15]", r"reciprocal\s+public\s+licen[cs]e", r"opensource\.org/licenses/rpl"),
    ("ricoh", r"RSCPL", r"ricoh\s+source\s+code\s+public\s+licen[cs]e", None),
    ("sgi-b", r"SGI-B-2\.0", r"SGI\s+free\s+software\s+licen[cs]e", r"oss\.sgi\.com/projects/freeb"),
    ("simpl", r"SimPL-2\.0", r"simple\s+public\s+licen[cs]e", r"opensource\.org/licenses/simpl"),
    ("sissl", r"SISSL", r"sun\s+industry\s+standards\s+source\s+licen[cs]e", r"opensource\.org/licenses/sisslpl"),
    ("sleepycat", r"Sleepycat", r"sleepycat\s+licen[cs]e", r"opensource\.org/licenses/sleepycat"),
    ("spl", r"SPL-1\.0", r"sun\s+public\s+licen[cs]e", r"opensource\.org/licenses/sunpublic"),
    ("tcl", r"TCL", r"tcl/tk\s+licen[cs]e", r"tcl\.tk/software/tcltk/license"),
    ("unicode", r"Unicode-(?:DFS-201[56]|TOU|3\.0)", r"unicode\s+licen[cs]e", r"unicode\.org/(?:copyright|license)"),
    ("vim", r"Vim", r"vim\s+licen[cs]e", r"vimhelp\.org/uganda"),
    ("vsl", r"VSL-1\.0", r"vovida\s+software\s+licen[cs]e", r"opensource\.org/licenses/vovidapl"),
    ("watcom", r"Watcom-1\.0", r"sybase\s+open\s+watcom\s+public\s+licen[cs]e", None),
    ("wxwindows", r"wxWindows", r"wxwindows\s+(?:library\s+)?licen[cs]e", r"opensource\.org/licenses/wxwindows"),
    ("x11", r"X11", r"X11\s+licen[cs]e|X\s+consortium\s+licen[cs]e", None),
    ("xfree86", r"XFree86-1\.1", r"xfree86\s+licen[cs]e", r"xfree86\.org/[\w./]*license"),
    ("xnet", r"Xnet", r"x\.net(?:,\s+inc\.?)?\s+licen[cs]e", r"opensource\.org/licenses/xnet"),
    ("zend", r"Zend-2\.0", r"zend\s+(?:engine\s+)?licen[cs]e", r"zend\.com/license"),
    ("zpl", r"ZPL-[12]\.\d", r"zope\s+public\s+licen[cs]e", r"opensource\.org/licenses/zpl"),
)

#: (label, a sentence of the license's own text)
TEXTS: tuple[tuple[str, str], ...] = (
    ("mit", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy\s+of\s+this\s+software"),
    ("mit", r"the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included\s+in\s+all\s+copies"),
    ("bsd", r"redistributions?\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification,\s+are\s+permitted"),
    ("bsd-3", r"neither\s+the\s+names?\s+of\s+[^\r\n]{1,120}\s+may\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products"),
    ("bsd-4", r"all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software"),
    ("isc", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee"),
    ("apache-2", r"unless\s+required\s+by\s+applicable\s+law\s+or\s+agreed\s+to\s+in\s+writing,\s+software\s+distributed\s+under\s+the\s+licen[cs]e"),
    ("apache-2", r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+licen[cs]e"),
    ("gpl", r"free\s+software[;:]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+GNU\s+general"),
    ("gpl", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+GNU\s+general\s+public\s+licen[cs]e"),
    ("lgpl", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+GNU\s+(?:lesser|library)\s+general\s+public\s+licen[cs]e"),
    ("agpl", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+GNU\s+affero\s+general\s+public\s+licen[cs]e"),
    ("gfdl", r"permission\s+is\s+granted\s+to\s+copy,\s+distribute\s+and/or\s+modify\s+this\s+document"),
    ("mpl-2", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+licen[cs]e"),
    ("mpl-1", r"the\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+mozilla\s+public\s+licen[cs]e"),
    ("epl", r"this\s+program\s+and\s+the\s+accompanying\s+materials\s+are\s+made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse"),
    ("cddl", r"the\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+terms\s+of\s+the\s+common\s+development"),
    ("unlicense", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("wtfpl", r"everyone\s+is\s+permitted\s+to\s+copy\s+and\s+distribute\s+verbatim\s+or\s+modified\s+copies\s+of\s+this\s+licen[cs]e"),
    ("bsl-1", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy\s+of\s+the\s+software"),
    ("zlib", r"this\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty"),
    ("zlib", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such"),
    ("cc-by", r"work\s+is\s+licen[cs]ed\s+under\s+a\s+creative\s+commons\s+attribution\s+\d"),
    ("cc-by-sa", r"work\s+is\s+licen[cs]ed\s+under\s+a\s+creative\s+commons\s+attribution-sharealike"),
    ("cc-by-nc", r"work\s+is\s+licen[cs]ed\s+under\s+a\s+creative\s+commons\s+attribution-noncommercial\s"),
    ("cc0", r"has\s+waived\s+all\s+copyright\s+and\s+related\s+or\s+neighbou?ring\s+rights"),
    ("python", r"PSF\s+hereby\s+grants\s+licen[cs]ee\s+a\s+nonexclusive,\s+royalty-free"),
    ("ofl", r"this\s+font\s+software\s+is\s+licen[cs]ed\s+under\s+the\s+SIL\s+open\s+font"),
    ("openssl", r"this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+openssl\s+project"),
    ("postgresql", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and\s+distribute\s+this\s+software\s+and\s+its\s+documentation\s+for\s+any\s+purpose"),
    ("artistic", r"the\s+intent\s+of\s+this\s+document\s+is\s+to\s+state\s+the\s+conditions\s+under\s+which\s+a\s+package\s+may\s+be\s+copied"),
    ("beerware", r"if\s+we\s+meet\s+some\s+day,\s+and\s+you\s+think\s+this\s+stuff\s+is\s+worth\s+it"),
    ("json", r"the\s+software\s+shall\s+be\s+used\s+for\s+good,\s+not\s+evil"),
    ("ncsa", r"deal\s+with\s+the\s+software\s+without\s+restriction"),
    ("curl", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted"),
    ("sspl", r"making\s+the\s+program\s+available\s+to\s+third\s+parties\s+as\s+a\s+service|make\s+the\s+functionality\s+of\s+the\s+program\s+or\s+a\s+modified\s+version\s+available"),
    ("elastic-2", r"you\s+may\s+not\s+provide\s+the\s+software\s+to\s+third\s+parties\s+as\s+a\s+hosted\s+or\s+managed\s+service"),
    ("busl", r"change\s+date,?\s+or\s+the\s+fourth\s+anniversary\s+of\s+the\s+first\s+publicly\s+available\s+distribution"),
    ("openrail", r"use-based\s+restrictions\s+as\s+referenced\s+in\s+paragraph\s+5"),
    ("upl", r"subject\s+to\s+the\s+condition\s+set\s+forth\s+below,\s+permission\s+is\s+hereby\s+granted"),
    ("freetype", r"portions\s+of\s+this\s+software\s+are\s+copyright\s+[^\r\n]{1,40}\s+the\s+freetype\s+project"),
    ("ijg", r"this\s+software\s+is\s+based\s+in\s+part\s+on\s+the\s+work\s+of\s+the\s+independent\s+jpeg\s+group"),
    ("vim", r"vim\s+is\s+charityware"),
    ("proprietary", r"unauthori[sz]ed\s+(?:copying|use|reproduction)\s+of\s+this\s+file,\s+via\s+any\s+medium,?\s+is\s+strictly\s+prohibited"),
    ("proprietary", r"proprietary\s+and\s+confidential"),
    ("all-rights-reserved", r"all\s+rights\s+reserved"),
)

#: Rank, confidence and frame of each kind; a smaller rank is stronger. `text` has TEXTS, the others SIGNATURES.
KINDS = (
    ("tag", 1, 1.0, r"SPDX-License-Identifier:[\w.+() \t-]*?(?<=(?::|\(|\bAND|\bOR|\bWITH)[ \t]{0,8})(?:{0})(?![\w+.-]*\w)"),
    ("text", 2, 0.95, r"{0}"),
    ("notice", 2, 0.95, r"(?:licen[cs]ed|released|distributed|available|published|provided|covered)\s+(?:to\s+you\s+)?(?:under|by|with)\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?|conditions\s+of\s+(?:the\s+)?)?(?:{0})"),
    ("address", 3, 0.9, r"(?:https?://)?(?:www\.)?(?:{0})"),
    ("name", 4, 0.7, r"(?<![\w-])(?:{0})(?!\w)"),
)
RANKS = tuple(sorted({rank for _, rank, _, _ in KINDS}))

#: Lower-cased, a text without any of these holds none of the signatures; the tests derive that from the patterns.
GATE = (
    "licen", "spdx", "domain", "cc0", "cc by", "cc-by", "commons", "attribution", "gpl", "mpl", "bsd", "gnu", "mulan", "permi", "reserved",
    "want", "wtfpl", "agreement", ".org", ".net", ".com/", ".co/", ".cn/", ".eu/", ".fr/", ".ca/", ".uk/", ".tk/", ".dev",
    "copyright", "restriction", "software", "independent", "confidential", "endorse", "eclipse", "subject", "altered", "package", "stuff", "program",
    "anniversary", "prohibited", "charityware",
)


@lru_cache(maxsize=1)
def rules() -> tuple[dict, ...]:
    """All rules in order: (id, rank, score, label, kind, cuts, pattern); a match holds a keyword of each cut."""
    out = []
    for kind, rank, score, frame in KINDS:
        bodies = TEXTS if kind == "text" else [(label, {"tag": ident, "notice": name, "name": name, "address": address}[kind]) for label, ident, name, address in SIGNATURES]
        for label, body in bodies:
            if body is not None:
                pattern = frame.replace("{0}", body)
                out.append({"id": len(out), "rank": rank, "score": score, "label": label, "kind": kind, "cuts": [sorted(c) for c in cuts(pattern)], "pattern": "(?i)" + pattern})
    return tuple(out)
