"""Signatures of licences, as patterns over the words of a text.

Words are in lower case, separated by single blanks; whatever is neither a
letter, a digit nor beyond ASCII separates words, so "GPL-2.0" is ``gpl 2 0``.
A pattern starts with plain words, which are its anchors, and ``@`` marks the
keyword without which it cannot match (the anchor if there is none).

Ranks, best first: an identifier tag, a sentence of a licence or a grant, a
name with its version or an address, a plain name, a mere hint.
"""

from __future__ import annotations

import re
from typing import NamedTuple

TAG, TEXT, VERSIONED, NAME, HINT = range(5)
#: How sure a detection of each rank is.
WEIGHTS = (1.0, 0.95, 0.9, 0.75, 0.4)
#: Words a pattern sees from its anchor on; no pattern may need more.
WIDTH = 48


class Rule(NamedTuple):
    label: str
    rank: int
    anchor: str
    keyword: str
    pattern: str

    @property
    def keywords(self) -> tuple[str, ...]:
        """The words one of which every match holds."""
        return ("license", "licence") if self.keyword == "licen" else tuple(self.keyword.split(" ")[-1:])


def _v(major: str, minor: str = "") -> str:
    """A version in its common forms."""
    tail = f" {minor}" if minor not in ("", "0") else "(?: 0)?" if minor else ""
    return f"(?: version| v)? v?{major}{tail}"


_LICENSE = "(?: public)?(?: software)? licen[cs]e"
_GNU = "(gnu) @general public licen[cs]e"
_LESSER = "(gnu) (?:lesser|library) @general public licen[cs]e"
_AFFERO = "(gnu) @affero general public licen[cs]e"
_FDL = "(gnu) free @documentation licen[cs]e"
_CC = "(creative) @commons attribution"
_INTL = "(?: international| unported| generic)?"
_CC_URL = "(creativecommons) org licenses "

# label, names (rank, pattern), tag, addresses
_FAMILIES = (
    ("mit", ((NAME, "(mit|expat) @licen[cs]e"), (NAME, "(mit) x11 @licen[cs]e"), (NAME, "(mit) style @licen[cs]e")), "mit", ("(opensource) org licenses? @mit", "(choosealicense) com licenses @mit")),
    ("mit-0", ((VERSIONED, "(mit) no @attribution"), (VERSIONED, "(mit) 0 @licen[cs]e")), "mit 0", ()),
    ("x11", ((NAME, "(x11) @licen[cs]e"), (NAME, "(x) consortium @licen[cs]e")), "x11", ()),
    ("isc", ((NAME, "(isc) @licen[cs]e"), (NAME, "(internet) systems consortium @licen[cs]e")), "isc", ("(opensource) org licenses? @isc",)),
    ("bsd", ((NAME, "(bsd) @licen[cs]e"), (NAME, "(bsd) style @licen[cs]e"), (NAME, "(berkeley) software distribution @licen[cs]e")), "bsd", ()),
    ("bsd-2-clause", ((VERSIONED, "(bsd) 2 @clause"), (VERSIONED, "(2|two) clause @bsd"), (VERSIONED, "(simplified) @bsd"), (VERSIONED, "(freebsd) @licen[cs]e")), "bsd 2 clause", ("(opensource) org licenses? @bsd 2 clause",)),
    ("bsd-3-clause", ((VERSIONED, "(bsd) 3 @clause"), (VERSIONED, "(3|three) clause @bsd"), (VERSIONED, "(modified|new|revised) @bsd licen[cs]e")), "bsd 3 clause", ("(opensource) org licenses? @bsd 3 clause",)),
    ("bsd-4-clause", ((VERSIONED, "(bsd) 4 @clause"), (VERSIONED, "(4|four) clause @bsd"), (VERSIONED, "(original) @bsd licen[cs]e")), "bsd 4 clause", ()),
    ("0bsd", ((VERSIONED, "(zero) clause @bsd"), (VERSIONED, "(0) clause @bsd")), "0bsd", ("(opensource) org licenses? @0bsd",)),
    ("apache-2.0", ((VERSIONED, f"(apache)(?: software)? @licen[cs]e{_v('2', '0')}"), (VERSIONED, "(asl|apl|apachev2) 2 0"), (VERSIONED, "(apache) 2 0")), "apache 2 0", ("(apache) org @licenses license 2 0", "(opensource) org licenses? @apache 2 0")),
    ("apache-1.1", ((VERSIONED, f"(apache)(?: software)? @licen[cs]e{_v('1', '1')}"),), "apache 1 1", ("(apache) org @licenses license 1 1",)),
    ("apache-1.0", ((VERSIONED, f"(apache)(?: software)? @licen[cs]e(?: version| v)? v?1 0"),), "apache 1 0", ("(apache) org @licenses license 1 0",)),
    ("apache", ((NAME, "(apache) software @licen[cs]e"), (NAME, "(apache) @licen[cs]e")), None, ()),
    ("gpl-1.0", ((VERSIONED, f"{_GNU}{_v('1', '0')}"), (VERSIONED, f"(gpl){_v('1', '0')}"), (VERSIONED, "(gplv1)")), "gpl 1 0(?: only| or later)?", ()),
    ("gpl-2.0", ((VERSIONED, f"{_GNU}{_v('2', '0')}"), (VERSIONED, f"(gpl){_v('2', '0')}"), (VERSIONED, "(gplv2|gpl2)(?: only)?"), (VERSIONED, f"(gnu) @gpl{_v('2', '0')}")), "gpl 2 0(?: only)?", ("(gnu) org licenses old licenses @gpl 2 0", "(opensource) org licenses? @gpl 2 0")),
    ("gpl-2.0-or-later", ((VERSIONED, f"{_GNU}{_v('2', '0')} or(?: at your option)?(?: any)? later"), (VERSIONED, "(gplv2|gpl2) or @later")), "gpl 2 0 or later", ()),
    ("gpl-3.0", ((VERSIONED, f"{_GNU}{_v('3', '0')}"), (VERSIONED, f"(gpl){_v('3', '0')}"), (VERSIONED, "(gplv3|gpl3)(?: only)?"), (VERSIONED, f"(gnu) @gpl{_v('3', '0')}")), "gpl 3 0(?: only)?", ("(gnu) org licenses @gpl 3 0", "(opensource) org licenses? @gpl 3 0")),
    ("gpl-3.0-or-later", ((VERSIONED, f"{_GNU}{_v('3', '0')} or(?: at your option)?(?: any)? later"), (VERSIONED, "(gplv3|gpl3) or @later")), "gpl 3 0 or later", ()),
    ("gpl", ((NAME, _GNU), (NAME, "(gnu) @gpl"), (NAME, "(gpl) @licen[cs]e"), (NAME, "(general) @public licen[cs]e")), None, ("(gnu) org @copyleft gpl", "(gnu) org @licenses gpl")),
    ("lgpl-2.0", ((VERSIONED, f"{_LESSER}{_v('2', '0')}"), (VERSIONED, f"(lgpl){_v('2', '0')}"), (VERSIONED, "(lgplv2)")), "lgpl 2 0(?: only| or later)?", ("(gnu) org licenses old licenses @lgpl 2 0",)),
    ("lgpl-2.1", ((VERSIONED, f"{_LESSER}{_v('2', '1')}"), (VERSIONED, f"(lgpl){_v('2', '1')}"), (VERSIONED, "(lgplv2) @1")), "lgpl 2 1(?: only| or later)?", ("(gnu) org licenses old licenses @lgpl 2 1", "(opensource) org licenses? @lgpl 2 1")),
    ("lgpl-3.0", ((VERSIONED, f"{_LESSER}{_v('3', '0')}"), (VERSIONED, f"(lgpl){_v('3', '0')}"), (VERSIONED, "(lgplv3)")), "lgpl 3 0(?: only| or later)?", ("(gnu) org licenses @lgpl 3 0", "(opensource) org licenses? @lgpl 3 0")),
    ("lgpl", ((NAME, _LESSER), (NAME, "(gnu) @lgpl"), (NAME, "(lgpl) @licen[cs]e"), (NAME, "(lesser|library) @general public licen[cs]e")), None, ("(gnu) org @copyleft lesser",)),
    ("agpl-3.0", ((VERSIONED, f"{_AFFERO}{_v('3', '0')}"), (VERSIONED, f"(agpl){_v('3', '0')}"), (VERSIONED, "(agplv3)")), "agpl 3 0(?: only| or later)?", ("(gnu) org licenses @agpl 3 0", "(opensource) org licenses? @agpl 3 0")),
    ("agpl", ((NAME, _AFFERO), (NAME, "(affero) @general public licen[cs]e"), (NAME, "(gnu) @agpl"), (NAME, "(agpl) @licen[cs]e")), None, ()),
    ("gfdl-1.2", ((VERSIONED, f"{_FDL}{_v('1', '2')}"), (VERSIONED, f"(gfdl){_v('1', '2')}")), "gfdl 1 2(?: only| or later)?", ()),
    ("gfdl-1.3", ((VERSIONED, f"{_FDL}{_v('1', '3')}"), (VERSIONED, f"(gfdl){_v('1', '3')}")), "gfdl 1 3(?: only| or later)?", ("(gnu) org licenses @fdl 1 3",)),
    ("gfdl", ((NAME, _FDL), (NAME, "(gnu) @fdl"), (NAME, "(gfdl)")), None, ("(gnu) org copyleft @fdl",)),
    ("mpl-1.1", ((VERSIONED, f"(mozilla) @public licen[cs]e{_v('1', '1')}"), (VERSIONED, f"(mpl){_v('1', '1')}")), "mpl 1 1", ("(mozilla) org @mpl 1 1",)),
    ("mpl-2.0", ((VERSIONED, f"(mozilla) @public licen[cs]e{_v('2', '0')}"), (VERSIONED, f"(mpl){_v('2', '0')}"), (VERSIONED, "(mplv2)")), "mpl 2 0", ("(mozilla) org @mpl 2 0", "(opensource) org licenses? @mpl 2 0")),
    ("mpl", ((NAME, "(mozilla) @public licen[cs]e"),), None, ("(mozilla) org @mpl",)),
    ("epl-1.0", ((VERSIONED, f"(eclipse) @public licen[cs]e{_v('1', '0')}"), (VERSIONED, f"(epl){_v('1', '0')}")), "epl 1 0", ("(eclipse) org legal @epl v10",)),
    ("epl-2.0", ((VERSIONED, f"(eclipse) @public licen[cs]e{_v('2', '0')}"), (VERSIONED, f"(epl){_v('2', '0')}")), "epl 2 0", ("(eclipse) org legal @epl 2 0", "(eclipse) org legal @epl v20")),
    ("epl", ((NAME, "(eclipse) @public licen[cs]e"),), None, ()),
    ("edl-1.0", ((VERSIONED, "(eclipse) @distribution licen[cs]e"),), None, ("(eclipse) org org documents @edl",)),
    ("cddl-1.0", ((VERSIONED, f"(common) @development and distribution licen[cs]e{_v('1', '0')}"), (VERSIONED, f"(cddl){_v('1', '0')}")), "cddl 1 0", ("(opensource) org licenses? @cddl 1 0",)),
    ("cddl", ((NAME, "(common) @development and distribution licen[cs]e"),), None, ()),
    ("cpl-1.0", ((VERSIONED, "(common) @public licen[cs]e"),), "cpl 1 0", ("(opensource) org licenses? @cpl1 0",)),
    ("cpal-1.0", ((VERSIONED, "(common) public @attribution licen[cs]e"),), "cpal 1 0", ()),
    ("ipl-1.0", ((VERSIONED, "(ibm) @public licen[cs]e"),), "ipl 1 0", ()),
    ("eupl-1.1", ((VERSIONED, f"(european) union @public licen[cs]e{_v('1', '1')}"), (VERSIONED, f"(eupl){_v('1', '1')}")), "eupl 1 1", ()),
    ("eupl-1.2", ((VERSIONED, f"(european) union @public licen[cs]e{_v('1', '2')}"), (VERSIONED, f"(eupl){_v('1', '2')}")), "eupl 1 2", ()),
    ("eupl", ((NAME, "(european) union @public licen[cs]e"),), None, ()),
    ("osl-3.0", ((VERSIONED, f"(open) software @licen[cs]e{_v('3', '0')}"),), "osl 3 0", ("(opensource) org licenses? @osl 3 0",)),
    ("afl-3.0", ((VERSIONED, f"(academic) free @licen[cs]e{_v('3', '0')}"),), "afl 3 0", ()),
    ("afl", ((NAME, "(academic) free @licen[cs]e"),), "afl(?: \\d){2}", ()),
    ("artistic-1.0", ((VERSIONED, f"(artistic) @licen[cs]e{_v('1', '0')}"),), "artistic 1 0(?: perl| cl8)?", ()),
    ("artistic-2.0", ((VERSIONED, f"(artistic) @licen[cs]e{_v('2', '0')}"),), "artistic 2 0", ("(perlfoundation) org @artistic license 2 0",)),
    ("artistic", ((NAME, "(artistic) @licen[cs]e"), (NAME, "(same) terms as @perl itself")), None, ("(opensource) org licenses? @artistic",)),
    ("bsl-1.0", ((VERSIONED, "(boost) @software licen[cs]e"),), "bsl 1 0", ("(boost) org @license 1 0",)),
    ("busl-1.1", ((VERSIONED, "(business) @source licen[cs]e"),), "busl 1 1", ("(mariadb) com @bsl11",)),
    ("sspl-1.0", ((VERSIONED, "(server) side @public licen[cs]e"),), "sspl 1 0", ()),
    ("elastic-2.0", ((VERSIONED, f"(elastic) @licen[cs]e{_v('2', '0')}"),), "elastic 2 0", ()),
    ("zlib", ((NAME, "(zlib) @licen[cs]e"), (NAME, "(zlib) libpng @licen[cs]e")), "zlib", ("(opensource) org licenses? @zlib",)),
    ("libpng", ((NAME, "(libpng) @licen[cs]e"),), "libpng(?: 2 0)?", ()),
    ("curl", ((NAME, "(curl) @licen[cs]e"),), "curl", ()),
    ("openssl", ((NAME, "(openssl) @licen[cs]e"),), "openssl", ()),
    ("postgresql", ((NAME, "(postgresql) @licen[cs]e"),), "postgresql", ("(opensource) org licenses? @postgresql",)),
    ("python-2.0", ((VERSIONED, f"(python) software foundation @licen[cs]e"), (VERSIONED, "(psf) @licen[cs]e")), "(?:python 2 0|psf 2 0)", ()),
    ("php-3.01", ((VERSIONED, "(php) @licen[cs]e"),), "php 3 01", ("(php) net @license 3 01",)),
    ("ruby", ((NAME, "(ruby) @licen[cs]e"), (NAME, "(same) terms as @ruby")), "ruby", ()),
    ("ncsa", ((NAME, "(university) of illinois @ncsa open source licen[cs]e"), (NAME, "(ncsa) open source @licen[cs]e")), "ncsa", ()),
    ("w3c", ((NAME, "(w3c) software(?: notice and)? @licen[cs]e"),), "w3c", ()),
    ("wtfpl", ((NAME, "(wtfpl)"), (NAME, "(do) what the fuck you want to @public licen[cs]e")), "wtfpl", ()),
    ("unlicense", ((NAME, "(the) @unlicense"), (NAME, "(unlicense) @licen[cs]e")), "unlicense", ("(unlicense) org",)),
    ("beerware", ((NAME, "(beer) ware @licen[cs]e"), (NAME, "(beerware) @licen[cs]e")), "beerware", ()),
    ("ms-pl", ((NAME, "(microsoft) @public licen[cs]e"),), "ms pl", ("(opensource) org licenses? @ms pl",)),
    ("ms-rl", ((NAME, "(microsoft) @reciprocal licen[cs]e"),), "ms rl", ()),
    ("apsl-2.0", ((VERSIONED, "(apple) @public source licen[cs]e"),), "apsl 2 0", ("(opensource) apple com @apsl",)),
    ("npl-1.1", ((VERSIONED, "(netscape) @public licen[cs]e"),), "npl 1 1", ()),
    ("qpl-1.0", ((VERSIONED, "(q) @public licen[cs]e"),), "qpl 1 0", ()),
    ("upl-1.0", ((VERSIONED, "(universal) @permissive licen[cs]e"),), "upl 1 0", ()),
    ("vim", ((NAME, "(vim) @licen[cs]e"),), "vim", ()),
    ("tcl", ((NAME, "(tcl) tk @licen[cs]e"),), "tcl", ()),
    ("ijg", ((NAME, "(independent) @jpeg group"),), "ijg", ()),
    ("hpnd", ((NAME, "(historical) @permission notice and disclaimer"),), "hpnd", ()),
    ("ofl-1.1", ((VERSIONED, "(sil) open @font licen[cs]e"), (VERSIONED, "(open) @font licen[cs]e")), "ofl 1 1", ("(scripts) sil org @ofl",)),
    ("odbl-1.0", ((VERSIONED, "(open) @database licen[cs]e"), (VERSIONED, "(odbl)")), "odbl 1 0", ("(opendatacommons) org licenses @odbl",)),
    ("odc-by-1.0", ((VERSIONED, "(open) data commons @attribution licen[cs]e"),), "odc by 1 0", ("(opendatacommons) org licenses @by",)),
    ("pddl-1.0", ((VERSIONED, "(public) domain @dedication and licen[cs]e"),), "pddl 1 0", ("(opendatacommons) org licenses @pddl",)),
    ("cc0-1.0", ((VERSIONED, "(cc0)(?: 1 0)?(?: universal)?"), (VERSIONED, "(creative) @commons zero"), (VERSIONED, "(creative) @commons public domain dedication")), "cc0 1 0", ("(creativecommons) org @publicdomain zero 1 0",)),
    ("cc-by-2.0", ((VERSIONED, f"{_CC} 2 [05]{_INTL}"), (VERSIONED, "(cc) by 2 [05]")), "cc by 2 [05]", (f"{_CC_URL}@by 2 [05]",)),
    ("cc-by-3.0", ((VERSIONED, f"{_CC} 3 0{_INTL}"), (VERSIONED, "(cc) by 3 0")), "cc by 3 0", (f"{_CC_URL}@by 3 0",)),
    ("cc-by-4.0", ((VERSIONED, f"{_CC} 4 0{_INTL}"), (VERSIONED, "(cc) by 4 0")), "cc by 4 0", (f"{_CC_URL}@by 4 0",)),
    ("cc-by-sa-3.0", ((VERSIONED, f"{_CC} share ?alike 3 0{_INTL}"), (VERSIONED, "(cc) by @sa 3 0")), "cc by sa 3 0", (f"{_CC_URL}by @sa 3 0",)),
    ("cc-by-sa-4.0", ((VERSIONED, f"{_CC} share ?alike 4 0{_INTL}"), (VERSIONED, "(cc) by @sa 4 0")), "cc by sa 4 0", (f"{_CC_URL}by @sa 4 0",)),
    ("cc-by-nc-3.0", ((VERSIONED, f"{_CC} non ?commercial 3 0{_INTL}"), (VERSIONED, "(cc) by @nc 3 0")), "cc by nc 3 0", (f"{_CC_URL}by @nc 3 0",)),
    ("cc-by-nc-4.0", ((VERSIONED, f"{_CC} non ?commercial 4 0{_INTL}"), (VERSIONED, "(cc) by @nc 4 0")), "cc by nc 4 0", (f"{_CC_URL}by @nc 4 0",)),
    ("cc-by-nd-4.0", ((VERSIONED, f"{_CC} no ?derivatives 4 0{_INTL}"), (VERSIONED, "(cc) by @nd 4 0")), "cc by nd 4 0", (f"{_CC_URL}by @nd 4 0",)),
    ("cc-by-nc-sa-4.0", ((VERSIONED, f"{_CC} non ?commercial share ?alike 4 0{_INTL}"), (VERSIONED, "(cc) by nc @sa 4 0")), "cc by nc sa 4 0", (f"{_CC_URL}by nc @sa 4 0",)),
    ("cc-by-nc-nd-4.0", ((VERSIONED, f"{_CC} non ?commercial no ?derivatives 4 0{_INTL}"), (VERSIONED, "(cc) by nc @nd 4 0")), "cc by nc nd 4 0", (f"{_CC_URL}by nc @nd 4 0",)),
    ("cc", ((NAME, "(creative) @commons licen[cs]e"), (NAME, f"{_CC}(?: share ?alike| non ?commercial| no ?derivatives){{0,2}} licen[cs]e")), None, (f"{_CC_URL}@by",)),
    ("public-domain", ((NAME, "(public) @domain"),), None, ("(creativecommons) org @publicdomain mark",)),
    ("openrail", ((NAME, "(open|openrail) @rail m"), (NAME, "(bigscience) @rail licen[cs]e"), (NAME, "(creativeml) open @rail m")), None, ()),
    ("llama", ((NAME, "(llama) [234](?: [0-9])? community @licen[cs]e"),), None, ()),
    ("proprietary", ((HINT, "(all) rights @reserved"), (HINT, "(proprietary) and @confidential"), (HINT, "(commercial) @licen[cs]e")), None, ()),
    ("eula", ((NAME, "(end) user @licen[cs]e agreement"),), None, ()),
)

# label, sentences of the licence's text or of the notice it asks for
_SENTENCES = (
    ("mit", "(permission) is hereby @granted free of charge to any person obtaining a copy"),
    ("mit", "(the) above copyright notice and this @permission notice shall be included in all copies"),
    ("isc", "(permission) to use copy modify and(?: or)? distribute this software for any @purpose with or without fee is hereby granted"),
    ("bsd", "(redistribution) and use in source and @binary forms with or without modification are permitted"),
    ("bsd", "(redistributions) of source code must @retain the above copyright notice"),
    ("bsd", "(redistributions) in binary form must @reproduce the above copyright notice"),
    ("bsd-3-clause", "(neither) the name of(?: \\S+){1,12} nor the names of its @contributors may be used to endorse"),
    ("bsd-3-clause", "(neither) the names? of the copyright holders? nor the names of its @contributors"),
    ("bsd-4-clause", "(all) @advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "(unless) required by @applicable law or agreed to in writing software distributed under the license"),
    ("apache-2.0", "(you) may not use this file except in @compliance with the license"),
    ("apache-2.0", "(the) asf licenses this file to you under the @apache license"),
    ("apache-1.1", "(this) product includes software developed by the @apache software foundation"),
    ("gpl", "(this) program is free software you can @redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "(you) should have received a copy of the @gnu general public licen[cs]e"),
    ("gpl-2.0-or-later", "(either) @version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3.0-or-later", "(either) @version 3 of the licen[cs]e or at your option any later version"),
    ("gpl-2.0", "(gnu) general public licen[cs]e @version 2 june 1991"),
    ("gpl-3.0", "(gnu) general public licen[cs]e @version 3 29 june 2007"),
    ("lgpl", "(this) library is free software you can @redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", "(you) should have received a copy of the gnu @lesser general public licen[cs]e"),
    ("agpl", "(you) should have received a copy of the gnu @affero general public licen[cs]e"),
    ("gfdl", "(permission) is granted to copy distribute and or modify this @document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl-2.0", "(this) source code @form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-1.1", "(the) contents of this file are subject to the @mozilla public licen[cs]e"),
    ("epl", "(this) program and the accompanying @materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl", "(the) contents of this file are subject to the terms of the @common development and distribution licen[cs]e"),
    ("unlicense", "(this) is free and @unencumbered software released into the public domain"),
    ("unlicense", "(anyone) is free to copy @modify publish use compile sell or distribute this software"),
    ("zlib", "(this) software is provided as is without any express or @implied warranty in no event will the authors be held liable"),
    ("zlib", "(altered) source versions must be @plainly marked as such"),
    ("bsl-1.0", "(permission) is hereby granted free of charge to any person or @organization obtaining a copy of the software"),
    ("ncsa", "(permission) is hereby granted free of charge(?: \\S+){4,16} to deal with the @software without restriction"),
    ("ofl-1.1", "(this) @font software is licensed under the sil open font licen[cs]e"),
    ("cc0-1.0", "(to) the extent possible under law(?: \\S+){1,12} has @waived all copyright"),
    ("beerware", "(as) long as you retain this notice you can do whatever you want with this @stuff"),
    ("wtfpl", "(everyone) is @permitted to copy and distribute verbatim or modified copies"),
    ("curl", "(permission) to use copy modify and distribute this software for any purpose with or without fee is hereby @granted provided"),
    ("hpnd", "(permission) to use copy modify and distribute this software and its @documentation for any purpose"),
    ("upl-1.0", "(the) @larger works? to which the software is contributed"),
    ("postgresql", "(permission) to use copy modify and distribute this software and its documentation for any purpose without fee and without a @written agreement"),
    ("public-domain", "(this) (?:work|file|software|code) (?:is|has been)(?: \\S+)? (?:in|released into|placed in) the public @domain"),
    ("proprietary", "(this) (?:software|document|material|program) (?:is|contains) (?:the )?@proprietary"),
    ("warranty-disclaimer", "(this|the) software is provided(?: by the copyright holders and contributors)? as is @without warranty of any kind"),
)

_UNDER = "under(?: the)?(?: terms(?: and conditions)?(?: of)?)?(?: the| a| an)? "
_TAG = "(spdx) license @identifier "

# The phrases that are always reported, with their labels.
BASE = (
    Rule("mit", NAME, "mit", "mit license", "mit license"),
    Rule("apache", NAME, "apache", "apache license", "apache license"),
    Rule("gpl", NAME, "general", "general public license", "general public license"),
)


def _rules(label: str, rank: int, pattern: str) -> list[Rule]:
    """One rule for each anchor of a pattern."""
    anchors, rest = re.fullmatch(r"\(([^()]*)\)(.*)", pattern).groups()
    marked = re.search(r"@(\w+)", rest)
    plain = rest.replace("@", "")
    return [Rule(label, rank, anchor, marked.group(1) if marked else anchor, anchor + plain) for anchor in anchors.split("|")]


def all_rules() -> list[Rule]:
    """Every rule, in order; of equal detections the earlier rule counts."""
    rules = []
    for label, names, tag, addresses in _FAMILIES:
        if tag:
            rules += _rules(label, TAG, _TAG + tag)
        for rank, pattern in names:
            plain = _rules(label, rank, pattern)
            rules += plain
            if rank != HINT:
                rules += [Rule(label, TEXT, "under", r.anchor, _UNDER + r.pattern) for r in plain]
        for pattern in addresses:
            rules += _rules(label, VERSIONED, pattern)
    for label, pattern in _SENTENCES:
        rules += _rules(label, TEXT, pattern)
    return rules


RULES = tuple(all_rules())
