"""License scans by ordered signature rules, in DataFrame operations only.

Hundreds of rules, each a regular expression with a label and keywords.  A text is
first tested for the words that its rules cannot do without; only then its keywords choose the
rules that run.  Detections are intervals; one that lies inside another is suppressed, and
of equal intervals the rule with the higher priority (listed first) stays.

Rules are written once for each licence (names, identifiers, addresses, characteristic
sentences); the general forms (tags, "licensed under", addresses) are applied to
each of them.  The base phrases of the contract are rules of their own that are
never suppressed.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import spans

#: Word characters and gaps where A-Z count as letters (patterns ignore their case).
WORD_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP_CLASS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Base phrases (words) and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, identifier in tags, name pattern (words joined by single spaces), further patterns.  Names stand in order of priority.
LICENCES = (
    ("mit-0", "MIT-0", "mit no attribution( license)?"),
    ("mit", "MIT", "(the )?(mit|expat)( \\(expat\\))? licen[sc]e", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-cmu", "MIT-CMU", "cmu licen[sc]e"),
    ("apache-1", "Apache-1.0", "apache( software)? licen[sc]e (version )?1 0"),
    ("apache-1.1", "Apache-1.1", "apache( software)? licen[sc]e (version )?1 1"),
    ("apache-2", "Apache-2.0", "apache( software)? licen[sc]e( version)? 2( 0)?", "apache 2( 0)? licen[sc]e", "apache org licenses license 2 0"),
    ("agpl-3.0-or-later", "AGPL-3.0-or-later", "(gnu )?affero general public licen[sc]e version 3 or (\\(at your option\\) )?any later version"),
    ("agpl-3.0", "AGPL-3.0", "(gnu )?affero general public licen[sc]e( as published by the free software foundation)?( either)?( version)? 3( 0)?", "gnu agpl ?v?3"),
    ("agpl", "AGPL", "(gnu )?affero general public licen[sc]e"),
    ("lgpl-2.0-or-later", "LGPL-2.0-or-later", "(gnu )?library general public licen[sc]e version 2 or any later version"),
    ("lgpl-2.0", "LGPL-2.0", "(gnu )?library general public licen[sc]e( version 2( 0)?)?"),
    ("lgpl-2.1-or-later", "LGPL-2.1-or-later", "(gnu )?lesser general public licen[sc]e version 2 1 or any later version"),
    ("lgpl-2.1", "LGPL-2.1", "(gnu )?lesser general public licen[sc]e( either)?( version)? 2 1", "gnu lgpl ?v?2 1"),
    ("lgpl-3.0-or-later", "LGPL-3.0-or-later", "(gnu )?lesser general public licen[sc]e version 3 or any later version"),
    ("lgpl-3.0", "LGPL-3.0", "(gnu )?lesser general public licen[sc]e( either)?( version)? 3( 0)?", "gnu lgpl ?v?3"),
    ("lgpl", "LGPL", "(gnu )?lesser general public licen[sc]e"),
    ("gpl-1.0", "GPL-1.0", "(gnu )?general public licen[sc]e( version)? 1( 0)?"),
    ("gpl-2.0-or-later", "GPL-2.0-or-later", "(gnu )?general public licen[sc]e version 2 or any later version", "either version 2 of the licen[sc]e or (\\(at your option\\) )?any later version"),
    ("gpl-2.0", "GPL-2.0", "(gnu )?general public licen[sc]e( either)?( version)? 2( 0)?", "gnu gpl ?v?2"),
    ("gpl-3.0-or-later", "GPL-3.0-or-later", "(gnu )?general public licen[sc]e version 3 or any later version", "either version 3 of the licen[sc]e or (\\(at your option\\) )?any later version"),
    ("gpl-3.0", "GPL-3.0", "(gnu )?general public licen[sc]e( either)?( version)? 3( 0)?", "gnu gpl ?v?3"),
    ("gpl", "GPL", "gnu general public licen[sc]e", "general public licen[sc]e"),
    ("gfdl-1.1", "GFDL-1.1", "(gnu )?free documentation licen[sc]e version 1 1"),
    ("gfdl-1.2", "GFDL-1.2", "(gnu )?free documentation licen[sc]e version 1 2"),
    ("gfdl-1.3", "GFDL-1.3", "(gnu )?free documentation licen[sc]e version 1 3"),
    ("gfdl", "GFDL", "(gnu )?free documentation licen[sc]e"),
    ("bsd-0", "0BSD", "(bsd zero clause|zero clause bsd) licen[sc]e"),
    ("bsd-1-clause", "BSD-1-Clause", "bsd 1 clause licen[sc]e"),
    ("bsd-2-clause", "BSD-2-Clause", "(bsd (2|two) clause|(2|two) clause bsd|simplified bsd|freebsd) licen[sc]e"),
    ("bsd-2-clause-patent", "BSD-2-Clause-Patent", "bsd (2|two) clause plus patent licen[sc]e"),
    ("bsd-3-clause-clear", "BSD-3-Clause-Clear", "clear bsd licen[sc]e"),
    ("bsd-3-clause", "BSD-3-Clause", "(bsd (3|three) clause|(3|three) clause bsd|(new|revised|modified) bsd) licen[sc]e", "redistributions? and use in source and binary forms with or without modification are permitted"),
    ("bsd-4-clause", "BSD-4-Clause", "(bsd (4|four) clause|(4|four) clause bsd|original bsd) licen[sc]e"),
    ("bsd", "BSD", "(the )?bsd( style)? licen[sc]e"),
    ("isc", "ISC", "(the )?isc licen[sc]e", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-1.0", "MPL-1.0", "mozilla public licen[sc]e( version)? 1 0"),
    ("mpl-1.1", "MPL-1.1", "mozilla public licen[sc]e( version)? 1 1"),
    ("mpl-2.0", "MPL-2.0", "mozilla public licen[sc]e( v(ersion)?)? 2( 0)?"),
    ("mpl", "MPL", "mozilla public licen[sc]e"),
    ("epl-1.0", "EPL-1.0", "eclipse public licen[sc]e( v(ersion)?)? 1( 0)?"),
    ("epl-2.0", "EPL-2.0", "eclipse public licen[sc]e( v(ersion)?)? 2( 0)?"),
    ("edl-1.0", "EDL-1.0", "eclipse distribution licen[sc]e"),
    ("cddl-1.0", "CDDL-1.0", "common development and distribution licen[sc]e( version 1( 0)?)?"),
    ("cddl-1.1", "CDDL-1.1", "common development and distribution licen[sc]e version 1 1"),
    ("cpl-1.0", "CPL-1.0", "common public licen[sc]e( version)? 1 0"),
    ("cpal-1.0", "CPAL-1.0", "common public attribution licen[sc]e"),
    ("eupl-1.1", "EUPL-1.1", "european union public licen[sc]e( version)? 1 1"),
    ("eupl-1.2", "EUPL-1.2", "european union public licen[sc]e( version)? 1 2"),
    ("eupl", "EUPL", "european union public licen[sc]e"),
    ("cc0-1.0", "CC0-1.0", "cc0( 1 0)?( universal)?( public domain dedication| licen[sc]e)", "creativecommons org publicdomain zero"),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0", "(creative commons )?attribution non ?commercial no ?deriv(ative)?s?( works)?", "cc by nc nd", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", "(creative commons )?attribution non ?commercial share ?alike", "cc by nc sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc", "CC-BY-NC-4.0", "(creative commons )?attribution non ?commercial", "creativecommons org licenses by nc"),
    ("cc-by-nd", "CC-BY-ND-4.0", "(creative commons )?attribution no ?deriv(ative)?s?( works)?", "cc by nd", "creativecommons org licenses by nd"),
    ("cc-by-sa", "CC-BY-SA-4.0", "(creative commons )?attribution share ?alike", "cc by sa", "creativecommons org licenses by sa"),
    ("cc-by", "CC-BY-4.0", "creative commons attribution( [1-4] 0)?( international| unported| generic)?( licen[sc]e)?", "creativecommons org licenses by"),
    ("cc", "CC", "creative commons licen[sc]e"),
    ("public-domain", "LicenseRef-public-domain", "(released|placed|dedicated) (in|into|to) the public domain", "public domain dedication", "public domain licen[sc]e"),
    ("pddl-1.0", "PDDL-1.0", "(open data commons )?public domain dedication and licen[sc]e"),
    ("odbl-1.0", "ODbL-1.0", "open (data commons open )?database licen[sc]e"),
    ("odc-by-1.0", "ODC-By-1.0", "open data commons attribution licen[sc]e"),
    ("unlicense", "Unlicense", "(the )?unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "WTFPL", "do what the f[a-z]+ you want to public licen[sc]e"),
    ("zlib", "Zlib", "(the )?zlib( libpng)? licen[sc]e", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "libpng-2.0", "(png reference library|libpng) licen[sc]e"),
    ("boost-1.0", "BSL-1.0", "boost software licen[sc]e( version 1 0)?"),
    ("busl-1.1", "BUSL-1.1", "business source licen[sc]e( 1 1)?"),
    ("sspl-1.0", "SSPL-1.0", "server side public licen[sc]e"),
    ("elastic-2.0", "Elastic-2.0", "elastic licen[sc]e( 2 0)?"),
    ("artistic-1.0", "Artistic-1.0", "artistic licen[sc]e 1 0"),
    ("artistic-2.0", "Artistic-2.0", "artistic licen[sc]e( version)? 2( 0)?"),
    ("artistic", "Artistic", "artistic licen[sc]e"),
    ("afl-3.0", "AFL-3.0", "academic free licen[sc]e( version)? 3 0"),
    ("afl", "AFL", "academic free licen[sc]e"),
    ("osl-3.0", "OSL-3.0", "open software licen[sc]e( version)? 3 0"),
    ("osl", "OSL", "open software licen[sc]e"),
    ("ofl-1.1", "OFL-1.1", "(sil )?open font licen[sc]e( version)?( 1 1)?"),
    ("ms-pl", "MS-PL", "microsoft public licen[sc]e"),
    ("ms-rl", "MS-RL", "microsoft reciprocal licen[sc]e"),
    ("postgresql", "PostgreSQL", "postgresql licen[sc]e"),
    ("python-2.0", "Python-2.0", "(python software foundation|psf) licen[sc]e( version 2)?"),
    ("php-3.01", "PHP-3.01", "php licen[sc]e( version 3 01)?"),
    ("ruby", "Ruby", "ruby licen[sc]e"),
    ("perl", "Artistic-1.0-Perl", "same terms as perl itself"),
    ("openssl", "OpenSSL", "openssl licen[sc]e"),
    ("ssleay", "SSLeay", "original ssleay licen[sc]e"),
    ("curl", "curl", "curl licen[sc]e"),
    ("x11", "X11", "(x11|x consortium) licen[sc]e"),
    ("ncsa", "NCSA", "(university of illinois ncsa|ncsa) open source licen[sc]e"),
    ("w3c", "W3C", "w3c software (notice and )?licen[sc]e"),
    ("vim", "Vim", "vim licen[sc]e"),
    ("beerware", "Beerware", "beer ?ware licen[sc]e"),
    ("json", "JSON", "json licen[sc]e", "the software shall be used for good not evil"),
    ("icu", "ICU", "icu licen[sc]e"),
    ("unicode", "Unicode-DFS-2016", "unicode licen[sc]e( agreement)?"),
    ("ftl", "FTL", "freetype( project)? licen[sc]e"),
    ("ijg", "IJG", "independent jpeg group licen[sc]e"),
    ("imagemagick", "ImageMagick", "imagemagick licen[sc]e"),
    ("intel", "Intel", "intel open source licen[sc]e"),
    ("ibm-ipl-1.0", "IPL-1.0", "ibm public licen[sc]e"),
    ("apsl-2.0", "APSL-2.0", "apple public source licen[sc]e"),
    ("qpl-1.0", "QPL-1.0", "q public licen[sc]e"),
    ("sleepycat", "Sleepycat", "sleepycat licen[sc]e"),
    ("npl-1.1", "NPL-1.1", "netscape public licen[sc]e"),
    ("rpl-1.5", "RPL-1.5", "reciprocal public licen[sc]e"),
    ("upl-1.0", "UPL-1.0", "universal permissive licen[sc]e"),
    ("mulan-psl-2", "MulanPSL-2.0", "mulan permissive software licen[sc]e"),
    ("ecl-2.0", "ECL-2.0", "educational community licen[sc]e"),
    ("lppl-1.3", "LPPL-1.3c", "latex project public licen[sc]e"),
    ("nasa-1.3", "NASA-1.3", "nasa open source agreement"),
    ("blueoak-1.0", "BlueOak-1.0.0", "blue oak model licen[sc]e"),
    ("polyform-nc", "PolyForm-Noncommercial-1.0.0", "polyform non ?commercial licen[sc]e"),
    ("cecill-2.1", "CECILL-2.1", "cecill( free software)? licen[sc]e"),
    ("openldap", "OLDAP-2.8", "openldap public licen[sc]e"),
    ("zpl-2.1", "ZPL-2.1", "zope public licen[sc]e"),
    ("watcom", "Watcom-1.0", "sybase open watcom public licen[sc]e"),
    ("openrail", "LicenseRef-OpenRAIL", "(open ?rail( m)?|responsible ai) licen[sc]e"),
    ("llama", "LicenseRef-Llama", "llama( [23])?( community)? licen[sc]e"),
    ("cc-sa-1.0", "CC-SA-1.0", "creative commons share ?alike 1 0", "creativecommons org licenses sa 1 0"),
    ("cc-nc-1.0", "CC-NC-1.0", "creative commons non ?commercial 1 0", "creativecommons org licenses nc 1 0"),
    ("cc-pdm-1.0", "CC-PDM-1.0", "public domain mark( 1 0)?", "creativecommons org publicdomain mark"),
    ("etalab-2.0", "etalab-2.0", "(etalab|open) licence( version)? 2 0 etalab", "licence ouverte( version)?( 2 0)?"),
    ("ogl-uk-3.0", "OGL-UK-3.0", "open government licen[sc]e( v| version )?3( 0)?", "nationalarchives gov uk doc open government licen[sc]e version 3"),
    ("ogl-uk", "OGL-UK-2.0", "open government licen[sc]e"),
    ("cdla-permissive-1.0", "CDLA-Permissive-1.0", "community data licen[sc]e agreement permissive( version)? 1 0"),
    ("cdla-permissive-2.0", "CDLA-Permissive-2.0", "community data licen[sc]e agreement permissive( version)? 2 0"),
    ("cdla-sharing-1.0", "CDLA-Sharing-1.0", "community data licen[sc]e agreement sharing"),
    ("c-uda-1.0", "C-UDA-1.0", "computational use of data agreement"),
    ("free-art-1.3", "LAL-1.3", "free art licen[sc]e( 1 3)?", "licence art libre"),
    ("d-fsl-1.0", "D-FSL-1.0", "german free software licen[sc]e", "deutsche freie software lizenz"),
    ("miros", "MirOS", "miros licen[sc]e"),
    ("motosoto", "Motosoto", "motosoto open source licen[sc]e"),
    ("multics", "Multics", "multics licen[sc]e"),
    ("naumen", "Naumen", "naumen public licen[sc]e"),
    ("nethack", "NGPL", "nethack general public licen[sc]e"),
    ("nokia", "Nokia", "nokia open source licen[sc]e"),
    ("ntp", "NTP", "ntp licen[sc]e"),
    ("oclc-2.0", "OCLC-2.0", "oclc research public licen[sc]e"),
    ("ogtsl", "OGTSL", "open group test suite licen[sc]e"),
    ("rpsl-1.0", "RPSL-1.0", "realnetworks public source licen[sc]e"),
    ("rscpl", "RSCPL", "ricoh source code public licen[sc]e"),
    ("simpl-2.0", "SimPL-2.0", "simple public licen[sc]e( 2 0)?"),
    ("sissl", "SISSL", "sun industry standards source licen[sc]e"),
    ("spl-1.0", "SPL-1.0", "sun public licen[sc]e"),
    ("vsl-1.0", "VSL-1.0", "vovida software licen[sc]e"),
    ("xnet", "Xnet", "x net licen[sc]e"),
    ("wxwindows", "wxWindows", "wxwindows library licen[sc]e"),
    ("eudatagrid", "EUDatagrid", "eu datagrid software licen[sc]e"),
    ("entessa", "Entessa", "entessa public licen[sc]e"),
    ("fair", "Fair", "fair licen[sc]e", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("frameworx-1.0", "Frameworx-1.0", "frameworx open licen[sc]e"),
    ("hpnd", "HPND", "historical permission notice and disclaimer"),
    ("lucent-1.02", "LPL-1.02", "lucent public licen[sc]e( version)? 1 02"),
    ("catosl-1.1", "CATOSL-1.1", "computer associates trusted open source licen[sc]e"),
    ("efl-2.0", "EFL-2.0", "eiffel forum licen[sc]e( version)? 2"),
    ("ncl", "LicenseRef-NCL", "non ?commercial use only", "for non ?commercial (purposes|research) only"),
    ("aladdin", "Aladdin", "aladdin free public licen[sc]e"),
    ("hippocratic-2.1", "Hippocratic-2.1", "hippocratic licen[sc]e( 2 1)?"),
    ("parity-7.0", "Parity-7.0.0", "parity public licen[sc]e( 7 0)?"),
    ("prosperity-3.0", "LicenseRef-Prosperity-3.0.0", "prosperity public licen[sc]e( 3 0)?"),
    ("commons-clause", "LicenseRef-Commons-Clause", "commons clause( licen[sc]e)? condition"),
    ("polyform-small", "PolyForm-Small-Business-1.0.0", "polyform small business licen[sc]e"),
    ("polyform-shield", "LicenseRef-PolyForm-Shield-1.0.0", "polyform shield licen[sc]e"),
    ("fsl-1.1", "FSL-1.1", "functional source licen[sc]e( version)?( 1 1)?"),
    ("confluent", "LicenseRef-Confluent", "confluent community licen[sc]e"),
    ("rsal", "LicenseRef-RSAL", "redis source available licen[sc]e"),
    ("cua-opl-1.0", "CUA-OPL-1.0", "cua office public licen[sc]e"),
    ("bittorrent-1.1", "BitTorrent-1.1", "bittorrent open source licen[sc]e"),
    ("cern-ohl-p", "CERN-OHL-P-2.0", "cern open hardware licen[sc]e( version)?( 2)? permissive"),
    ("cern-ohl-s", "CERN-OHL-S-2.0", "cern open hardware licen[sc]e( version)?( 2)? strongly reciprocal"),
    ("cern-ohl-w", "CERN-OHL-W-2.0", "cern open hardware licen[sc]e( version)?( 2)? weakly reciprocal"),
    ("cern-ohl", "CERN-OHL-1.2", "cern open hardware licen[sc]e"),
    ("solderpad", "SHL-2.1", "solderpad hardware licen[sc]e"),
    ("tapr-ohl", "TAPR-OHL-1.0", "tapr open hardware licen[sc]e"),
    ("bitstream-vera", "Bitstream-Vera", "bitstream vera( fonts)? (licen[sc]e|copyright)"),
    ("ubuntu-font", "LicenseRef-UFL-1.0", "ubuntu font licen[sc]e"),
    ("gust-font", "GUST-Font-License", "gust font licen[sc]e"),
    ("tcl", "TCL", "tcl( tk)? licen[sc]e"),
    ("info-zip", "Info-ZIP", "info zip licen[sc]e"),
    ("bzip2", "bzip2-1.0.6", "bzip2( and libbzip2)? licen[sc]e"),
    ("libtiff", "libtiff", "libtiff licen[sc]e"),
    ("hdf5", "LicenseRef-HDF5", "hdf5 (software library )?licen[sc]e"),
    ("gemma", "LicenseRef-Gemma", "gemma terms of use"),
    ("falcon", "LicenseRef-Falcon", "falcon llm licen[sc]e"),
    ("deepseek", "LicenseRef-DeepSeek", "deepseek( model)? licen[sc]e( agreement)?"),
    ("qwen", "LicenseRef-Qwen", "(tongyi )?qwen( research)? licen[sc]e agreement"),
    ("mistral-research", "LicenseRef-MNPL", "mistral ai( non production| research) licen[sc]e"),
    ("proprietary", "LicenseRef-Proprietary", "all rights reserved", "proprietary and confidential"),
)

#: Rules that the regular expressions of one licence's name and tag take part in: (form, confidence); {0} is the name or tag.
_NAME_FORMS = (("(licensed|released|distributed|available|published) under( the terms of)? (the )?{0}", 1.0), ("{0}", 0.8))
_TAG_FORMS = ((r"spdx license identifier:?\s*{0}", 1.0), (r"licen[sc]e\s*[:=]\s*[\"']?{0}", 0.9))


def _words(pattern: str) -> str:
    """A pattern whose single spaces stand for any run of non-word characters."""
    return pattern.replace(" ", f"{GAP_CLASS}+")


def _literals(pattern: str) -> list[str]:
    """Literal runs that every match contains, in lower case: the words free of alternatives and options."""
    depth, current, out = 0, "", []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c in "([":
            depth += 1
            out.append(current)
            current = ""
        elif c in ")]":
            depth -= 1
        elif depth == 0 and (c.isalnum()):
            if pattern[i + 1 : i + 2] not in ("?", "*"):
                current += c
            else:
                out.append(current)
                current = ""
        elif depth == 0:
            out.append(current)
            current = ""
        i += 1
    out.append(current)
    return [x for x in out if x]


#: Words of so many names that they tell rules apart badly.
_COMMON = ("licen", "public", "general", "software", "source", "version")


def _keyword(pattern: str) -> str:
    """The longest of the literal runs, a word of few names where there is one."""
    return max(_literals(pattern), key=lambda x: (x not in _COMMON and len(x) > 1, len(x)))


def _edge(body: str) -> str:
    return f"(?i)(?<!{WORD_CLASS})(?:{body})(?!{WORD_CLASS})"


def anchors() -> tuple[list[tuple[str, ...]], str]:
    """What a text with any detection holds, derived from the rules: all words of one of the sets, or a match of the expression.

    Rules in tags and most names need "licen"; each other name needs all its literal
    runs; names of short words alone ("cc by sa") are searched as they are.
    """
    sets, short = {("licen",)}, []
    for _, _, *names in LICENCES:
        for name in names:
            need = sorted({x for x in _literals(name) if len(x) > 2}, key=lambda x: (-len(x), x))
            if not need:
                short.append(name)
            elif not any("licen" in x for x in need):
                sets.add(tuple(need))
    return sorted(x for x in sets if not any(y != x and set(y) < set(x) for y in sets)), _edge("|".join(map(_words, short)))


def rules() -> list[tuple[str, str, str, float]]:
    """All rules in order of priority: (label, regular expression, keyword, confidence)."""
    out = []
    for form, confidence in _TAG_FORMS:
        for label, tag, *_ in LICENCES:
            body = GAP_CLASS.join("".join(f"\\{c}" if c in "+" else c for c in part) for part in tag.replace(".", "-").split("-"))
            out.append((label, _edge(form.format(body).replace(" ", f"{GAP_CLASS}+")), max(tag.lower().replace(".", "-").split("-"), key=len), confidence))
    for form, confidence in _NAME_FORMS:
        for label, _, *names in LICENCES:
            out += [(label, _edge(_words(form.format(f"(?:{name})"))), _keyword(name), confidence) for name in names]
    return out


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (and text, detections).

    Null and empty texts have no words and no labels (empty strings), null places and score 0.
    Repeated rows are scanned each; other columns are not read.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    low = F.lower("text")
    count_words = lambda c: F.size(F.array_remove(F.split(c, f"{GAP_CLASS}+", -1), ""))
    none = F.array().cast("array<int>")

    def places(phrase: str) -> Column:
        """Word numbers where the phrase begins: words before it, from the pieces between the phrases."""
        words = phrase.split(" ")
        pattern = f"(?i)(?<!{WORD_CLASS}){_words(phrase)}(?!{WORD_CLASS})"
        pieces = F.transform(F.split("text", pattern, -1), count_words)
        before = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, n: F.struct((a["at"] + n + len(words)).alias("at"), F.concat(a["out"], F.array(a["at"] + n)).alias("out")), lambda a: a["out"])
        gate = F.lit(True)
        for w in sorted(set(words), key=len, reverse=True)[:2]:
            gate = gate & low.contains(w)
        return F.when(gate, F.when(F.col("text").rlike(pattern), before)).otherwise(F.lit(None))

    found = base.select("doc_id", "text", *(F.coalesce(places(p), none).alias(f"_p{i}") for i, p in enumerate(PHRASES)))
    table = rules()
    sets, short = anchors()
    anchored = F.lit(False)
    for need in sets:
        anchored = anchored | reduce(and_, (low.contains(x) for x in need))
    anchored = anchored | F.col("text").rlike(short)
    # one constant for the optimiser to fold, instead of thousands of literals to build; each keyword is sought once for all its rules
    by_key: dict[str, list[dict]] = {}
    for i, (label, pattern, key, confidence) in enumerate(table):
        by_key.setdefault(key, []).append({"priority": i, "label": label, "pattern": pattern, "confidence": confidence})
    text = json.dumps([{"key": key, "rules": own} for key, own in by_key.items()])
    keyed = F.from_json(F.lit(text), "array<struct<key: string, rules: array<struct<priority: int, label: string, pattern: string, confidence: double>>>>")
    found = found.withColumn("_low", F.when(anchored, low))
    chosen = F.flatten(F.transform(F.filter(keyed, lambda k: F.contains(F.col("_low"), k["key"])), lambda k: k["rules"]))
    found = found.withColumn("_rules", F.when(F.col("_low").isNotNull(), chosen))

    def matches(r: Column) -> Column:
        return F.transform(spans("text", r["pattern"]), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))

    found = found.withColumn("_matches", F.when(F.size("_rules") > 0, F.array_sort(F.flatten(F.transform("_rules", lambda r: F.when(F.rlike(F.col("text"), r["pattern"]), matches(r)).otherwise(F.array().cast("array<struct<start:int,back:int,priority:int,label:string,confidence:double>>")))))))
    # in order of start, then falling end, then priority: what ends within an earlier one lies inside it
    kind = "array<struct<start:int,end:int,label:string,confidence:double>>"
    kept = F.aggregate(
        "_matches", F.struct(F.lit(-1).alias("to"), F.array().cast(kind).alias("out")),
        lambda a, m: F.when(-m["back"] <= a["to"], a).otherwise(F.struct((-m["back"]).alias("to"), F.concat(a["out"], F.array(F.struct(m["start"].alias("start"), (-m["back"]).alias("end"), m["label"].alias("label"), m["confidence"].alias("confidence")))).alias("out"))),
        lambda a: a["out"],
    )
    found = found.withColumn("detections", F.coalesce(kept, F.array().cast(kind)))
    all_places = F.concat(*(F.col(f"_p{i}") for i in range(len(PHRASES))))
    own = F.filter(F.array(*(F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))), lambda x: x.isNotNull())
    longest = F.greatest(*(F.when(F.size(f"_p{i}") > 0, F.array_max(f"_p{i}")) for i in range(len(PHRASES))))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.when(F.size(own) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)))
    return found.select(
        "doc_id", count_words("text").cast("long").alias("n_words"), F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"), longest.cast("long").alias("last_word"),
        joined(own).alias("base_labels"), joined(F.concat(own, F.transform("detections", lambda d: d["label"]))).alias("labels"), score.alias("score"),
        *(["text", "detections"] if keep_text else []),
    )
