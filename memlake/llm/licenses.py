"""License scans: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment."""

from __future__ import annotations

from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.llm.common import names_kept

#: A word: a run of letters, digits and all beyond ASCII; A-Z lowered where words are compared.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (label, title: regex over lower-case words with single spaces, versions: regex or ""). The title is what stands before
#: the word "license" or in "licensed under the ..."; written by hand, in order of priority.
FAMILIES: tuple[tuple[str, str, str], ...] = (
    ("agpl", r"(?:gnu )?affero general public|agpl", r"(?:v|version )?[13](?: 0)?"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public|lgpl", r"(?:v|version )?(?:2 [01]|3 0|2|3)"),
    ("gpl", r"(?:gnu )?general public|gnu gpl|gpl", r"(?:v|version )?[123](?: 0)?"),
    ("gfdl", r"(?:gnu )?free documentation|gfdl", r"(?:v|version )?1 [123]"),
    ("cc-by-nc-sa", r"(?:cc|creative commons) by nc sa|creative commons attribution non ?commercial share ?alike", r"[1234] [05]"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", r"[1234] [05]"),
    ("cc-by-nc", r"(?:cc|creative commons) by nc|creative commons attribution non ?commercial", r"[1234] [05]"),
    ("cc-by-sa", r"(?:cc|creative commons) by sa|creative commons attribution share ?alike", r"[1234] [05]"),
    ("cc-by-nd", r"(?:cc|creative commons) by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?", r"[1234] [05]"),
    ("cc-by", r"(?:cc|creative commons) by|creative commons attribution", r"[1234] [05]"),
    ("cc0", r"cc0|creative commons zero|cc zero", r"1 0"),
    ("cc", r"creative commons", r""),
    ("apache", r"apache(?: software)?|asl|apl", r"(?:v|version )?(?:1 [01]|2 0|2)"),
    ("mit", r"mit|mit x11|x11 mit|expat", r""),
    ("mit-0", r"mit 0|mit no attribution", r""),
    ("x11", r"x11|x consortium", r""),
    ("bsd-4", r"bsd 4 clause|4 clause bsd|four clause bsd|original bsd", r""),
    ("bsd-3", r"bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd", r""),
    ("bsd-2", r"bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd", r""),
    ("bsd-0", r"bsd zero clause|zero clause bsd|0bsd", r""),
    ("bsd", r"bsd|berkeley software distribution", r""),
    ("isc", r"isc|internet systems consortium|internet software consortium", r""),
    ("mpl", r"mozilla public|mpl", r"(?:v|version )?(?:1 [01]|2 0|2)"),
    ("epl", r"eclipse public|epl", r"(?:v|version )?[12](?: 0)?"),
    ("edl", r"eclipse distribution|edl", r"(?:v|version )?1 0"),
    ("cddl", r"common development and distribution|cddl", r"(?:v|version )?1 [01]"),
    ("cpl", r"common public(?: attribution)?|cpl|cpal", r"(?:v|version )?1 0"),
    ("ipl", r"ibm public", r"(?:v|version )?1 0"),
    ("eupl", r"european union public|eupl", r"(?:v|version )?1 [012]"),
    ("osl", r"open software|osl", r"(?:v|version )?[123] [01]"),
    ("afl", r"academic free|afl", r"(?:v|version )?[123] [012]"),
    ("ecl", r"educational community|ecl", r"(?:v|version )?[12] 0"),
    ("artistic", r"(?:perl )?artistic|clarified artistic", r"(?:v|version )?[12] 0"),
    ("zlib", r"zlib|zlib libpng|libpng", r""),
    ("boost", r"boost software|boost|bsl", r"(?:v|version )?1 [01]"),
    ("busl", r"business source|busl", r"(?:v|version )?1 1"),
    ("sspl", r"server side public|sspl", r"(?:v|version )?1(?: 0)?"),
    ("elastic", r"elastic", r"(?:v|version )?2(?: 0)?"),
    ("unlicense", r"unlicense|unlicence", r""),
    ("wtfpl", r"wtfpl|do what the fuck you want to public", r"(?:v|version )?[12]"),
    ("python", r"python(?: software foundation)?|psf", r"(?:v|version )?[23](?: 0)?"),
    ("php", r"php", r"(?:v|version )?3 0[01]?"),
    ("ruby", r"ruby", r""),
    ("perl", r"perl|same terms as perl", r""),
    ("postgresql", r"postgresql|postgres", r""),
    ("openssl", r"openssl|ssleay", r""),
    ("curl", r"curl", r""),
    ("ncsa", r"university of illinois ncsa(?: open source)?|ncsa", r""),
    ("w3c", r"w3c(?: software)?", r""),
    ("ofl", r"(?:sil )?open font|ofl", r"(?:v|version )?1 [01]"),
    ("odbl", r"open data(?:base| commons open database)|odbl", r"(?:v|version )?1 0"),
    ("odc-by", r"open data commons attribution|odc by", r"(?:v|version )?1 0"),
    ("pddl", r"public domain dedication and|pddl", r"(?:v|version )?1 0"),
    ("ms-pl", r"microsoft public|ms pl", r""),
    ("ms-rl", r"microsoft reciprocal|ms rl", r""),
    ("rpl", r"reciprocal public|rpl", r"(?:v|version )?1 [15]"),
    ("qpl", r"q public|qpl", r"(?:v|version )?1 0"),
    ("sleepycat", r"sleepycat", r""),
    ("cecill-b", r"cecill b", r""),
    ("cecill-c", r"cecill c", r""),
    ("cecill", r"cecill", r"(?:v|version )?[12] [01]"),
    ("upl", r"universal permissive|upl", r"(?:v|version )?1 0"),
    ("lppl", r"latex project public|lppl", r"(?:v|version )?1 [0-3][abc]?"),
    ("nasa", r"nasa open source(?: agreement)?|nosa", r"(?:v|version )?1 3"),
    ("apsl", r"apple public source|apsl", r"(?:v|version )?[12] [012]"),
    ("npl", r"netscape public|npl", r"(?:v|version )?1 [01]"),
    ("spl", r"sun public|spl", r"(?:v|version )?1 0"),
    ("vim", r"vim", r""),
    ("beerware", r"beer ?ware", r""),
    ("json", r"json", r""),
    ("openrail", r"(?:creative ml |bigscience )?open ?rail(?: m)?", r""),
    ("llama", r"llama(?: 2| 3)?(?: community)?", r""),
)

#: Titles, or forms of titles, that name nothing but a license, and so need not be followed by the word.
CLEAR = frozenset((
    r"(?:gnu )?affero general public", "agpl", r"(?:gnu )?(?:lesser|library) general public", "lgpl", r"(?:gnu )?general public", "gnu gpl", "gpl", "gfdl",
    r"(?:cc|creative commons) by nc sa", r"creative commons attribution non ?commercial share ?alike", r"(?:cc|creative commons) by nc nd",
    r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", r"(?:cc|creative commons) by nc", r"creative commons attribution non ?commercial",
    r"(?:cc|creative commons) by sa", r"creative commons attribution share ?alike", r"(?:cc|creative commons) by nd",
    r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?", r"(?:cc|creative commons) by", "creative commons attribution", "cc0", "creative commons zero", "cc zero", "creative commons",
    "bsd 4 clause", "4 clause bsd", "four clause bsd", "bsd 3 clause", "3 clause bsd", "three clause bsd", "bsd 2 clause", "2 clause bsd", "two clause bsd", "bsd zero clause", "zero clause bsd", "0bsd",
    "mpl", "cddl", "cpal", "eupl", "busl", "sspl", "unlicense", "unlicence", "wtfpl", "odbl", "odc by", "pddl", "ms pl", "ms rl", "cecill b", "cecill c", "cecill", "lppl", "apsl", "beer ?ware", "same terms as perl",
    r"(?:creative ml |bigscience )?open ?rail(?: m)?",
))
#: Titles that name a license where a version follows; without one they also name a body, a league or a language.
VERSIONED = frozenset((r"apache(?: software)?", "asl", "apl", "epl", "edl", "cpl", "osl", "afl", "ecl", r"(?:perl )?artistic", "bsl", "ofl", "upl", "rpl", "qpl", "nosa", "npl", "spl"))

#: (label, gate word, what stands before it, what stands after it): sentences of notices and license texts, by hand, in
#: order of priority. The gate is a word that other texts seldom have.
BODIES: tuple[tuple[str, str, str, str], ...] = (
    ("agpl", "affero", r"under the terms of the gnu ", r" general public license(?: version [13])? as published by the free software foundation"),
    ("agpl", "remotely", r"all users interacting with it ", r" through a computer network"),
    ("lgpl", "redistribute", r"this library is free software you can ", r" it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("gpl", "redistribute", r"this program is free software you can ", r" it and or modify it under the terms of the gnu general public license"),
    ("gpl", "redistribute", r"free software you can ", r" it and or modify it"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute ", r" copies of this license document but changing it is not allowed"),
    ("wtfpl", "verbatim", r"everyone is permitted to copy and distribute ", r" or modified copies of this license document"),
    ("gpl", "merchantability", r"without any warranty without even the implied warranty of ", r" or fitness for a particular purpose"),
    ("gpl", "option", r"either version [123] of the license or at your ", r" any later version"),
    ("gfdl", "invariant", r"with no ", r" sections no front cover texts and no back cover texts"),
    ("boost", "organization", r"permission is hereby granted free of charge to any person or ", r" obtaining a copy of the software and accompanying documentation"),
    ("mit", "sublicense", r"without limitation the rights to use copy modify merge publish distribute ", r" and or sell copies of the software"),
    ("mit", "charge", r"permission is hereby granted free of ", r" to any person(?: obtaining a copy of this software and associated documentation files)?"),
    ("mit", "portions", r"this permission notice shall be included in all copies or substantial ", r" of the software"),
    ("mit", "noninfringement", r"fitness for a particular purpose and ", r" in no event shall the authors or copyright holders be liable"),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is ", r" granted"),
    ("isc", "copy", r"permission to use ", r" modify and or distribute this software"),
    ("isc", "disclaims", r"the (?:software is provided as is and the )?author ", r" all warranties with regard to this software"),
    ("bsd-4", "advertising", r"all ", r" materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3", "endorse", r"(?:contributors|name) may (?:not )?be used to ", r" or promote products derived from this software"),
    ("bsd-3", "nor", r"neither the name of [^ ]+(?: [^ ]+)?(?: [^ ]+)? ", r" the names of its contributors"),
    ("bsd", "redistribution", r"", r" and use in source and binary forms(?: with or without modification are permitted)?"),
    ("bsd", "redistributions", r"", r" (?:of source code must retain|in binary form must reproduce) the above copyright notice"),
    ("bsd", "governed", r"use of this source code is ", r" by a bsd style license"),
    ("bsd", "consequential", r"indirect incidental special exemplary or ", r" damages"),
    ("apache", "applicable", r"unless required by ", r" law or agreed to in writing software distributed under the license"),
    ("apache", "obtain", r"you may not use this file except in compliance with the license you may ", r" a copy of the license at"),
    ("apache", "contributor", r"licensed to the apache software foundation asf under one or more ", r" license agreements"),
    ("apache", "irrevocable", r"perpetual worldwide non exclusive no charge royalty free ", r" (?:copyright|except as stated)"),
    ("mpl", "subject", r"this source code form is ", r" to the terms of the mozilla public license(?: v 2 0)?"),
    ("mpl", "subject", r"the contents of this file are ", r" to the mozilla public license(?: version 1 [01])?"),
    ("mpl", "incompatible", r"this source code form is ", r" with secondary licenses"),
    ("cddl", "subject", r"the contents of this file are ", r" to the terms of the common development and distribution license"),
    ("epl", "accompanying", r"this program and the ", r" materials are made available under the terms of the eclipse public license"),
    ("cc0", "neighboring", r"waived all copyright and related or ", r" rights"),
    ("cc-by-sa", "remix", r"(?:if you )?", r" transform or build upon the material you must distribute your contributions under the same license"),
    ("cc", "adapt", r"you are free to share copy and redistribute the material in any medium or format ", r" remix transform and build upon the material"),
    ("zlib", "plainly", r"altered source versions must be ", r" marked as such"),
    ("zlib", "misrepresented", r"the origin of this software must not be ", r""),
    ("unlicense", "unencumbered", r"this is free and ", r" software released into the public domain"),
    ("unlicense", "dedicate", r"the author or authors of this software ", r" any and all copyright interest in the software to the public domain"),
    ("ofl", "font", r"this ", r" software is licensed under the sil open font license"),
    ("openssl", "toolkit", r"developed by the openssl project for use in the openssl ", r""),
    ("php", "freely", r"this product includes php software ", r" available from"),
    ("python", "psf", r"", r" hereby grants licensee a nonexclusive royalty free world wide license"),
    ("elastic", "managed", r"you may not provide the software to third parties as a hosted or ", r" service"),
    ("busl", "licensor", r"the ", r" may make an additional use grant"),
    ("sspl", "functionality", r"if you make the ", r" of the program or a modified version available to third parties as a service"),
    ("artistic", "package", r"the intent of this document is to state the conditions under which a ", r" may be copied"),
    ("ms-pl", "contributor", r"each ", r" grants you a non exclusive worldwide royalty free (?:copyright|license)"),
    ("upl", "unmodified", r"larger works? to which the software is contributed by such licensors without (?:restriction|limitation) ", r""),
    ("ncsa", "endorse", r"neither the names of (?:[^ ]+ ){1,4}nor the names of its contributors may be used to ", r" or promote products derived from this software without specific prior"),
    ("json", "evil", r"the software shall be used for good not ", r""),
    ("beerware", "stuff", r"you can do whatever you want with this ", r""),
    ("curl", "curl", r"copyright (?:[^ ]+ ){0,4}daniel stenberg (?:[^ ]+ ){0,3}", r""),
    ("vim", "uganda", r"(?:charityware|encouraged to make a donation for needy children in) ", r""),
    ("agpl", "license", r"you should have received a copy of the gnu affero general public ", r" along with this program"),
    ("lgpl", "license", r"you should have received a copy of the gnu (?:lesser|library) general public ", r" along with this library"),
    ("gpl", "license", r"you should have received a copy of the gnu general public ", r" along with this program"),
    ("lgpl", "distributed", r"this library is ", r" in the hope that it will be useful but without any warranty"),
    ("gpl", "distributed", r"this program is ", r" in the hope that it will be useful but without any warranty"),
    ("apache", "distributed", r"", r" on an as is basis without warranties or conditions of any kind"),
    ("mpl", "distributed", r"if a copy of the mpl was not ", r" with this file you can obtain one"),
    ("epl", "available", r"this program and the accompanying materials are made ", r" under the terms of the eclipse public license"),
    ("boost", "distributed", r"", r" under the boost software license version 1 0 see accompanying file"),
    ("zlib", "distribution", r"this notice may not be removed or altered from any source ", r""),
    ("unlicense", "distribute", r"anyone is free to copy modify publish use compile sell or ", r" this software either in source code form or as a compiled binary"),
    ("cc0", "domain", r"dedicated the work to the public ", r" by waiving all of (?:his or her|their) rights"),
    ("mit", "merchantability", r"including but not limited to the warranties of ", r" fitness for a particular purpose and noninfringement"),
    ("isc", "merchantability", r"including all implied warranties of ", r" and fitness in no event shall the author be liable"),
    ("bsd", "merchantability", r"the implied warranties of ", r" and fitness for a particular purpose are disclaimed"),
    ("postgresql", "hereby", r"for any purpose without fee and without a written agreement is ", r" granted"),
    ("x11", "advertising", r"shall not be used in ", r" or otherwise to promote the sale use or other dealings in this software"),
    ("w3c", "licensee", r"by obtaining using and or copying this (?:work|software) you the ", r" agree"),
    ("sleepycat", "obtain", r"redistributions in any form must be accompanied by information on how to ", r" complete source code"),
    ("mit", "license", r"mit (?:style|like) ", r""),
    ("bsd", "license", r"bsd (?:style|like) ", r""),
    ("public-domain", "disclaims", r"the author ", r" copyright to this source code"),
)

#: The same for phrases that any license may hold; they come last.
GENERAL: tuple[tuple[str, str, str, str], ...] = (
    ("public-domain", "domain", r"(?:released|dedicated|placed) (?:to|into|in) the public ", r""),
    ("public-domain", "domain", r"(?:is|are|was) (?:in |into )?(?:the )?public ", r""),
    ("proprietary", "unauthorized", r"", r" copying of (?:this file|this software) via any medium is strictly prohibited"),
    ("proprietary", "confidential", r"", r" and proprietary"),
    ("proprietary", "license", r"(?:proprietary|(?:a|our|your|paid|separate) commercial) ", r""),
    ("all-rights-reserved", "reserved", r"all rights ", r""),
)

#: Base phrases and their labels.
BASE: tuple[tuple[str, str], ...] = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

GATES = tuple(sorted({"license", "licence", "licensed", "licenced", "released", "distributed", "available", "terms", "spdx"} | {b[1] for b in BODIES + GENERAL}))

#: A text without any of these holds no gate word.
STEMS = ("licens", "licenc", "distrib", "releas", *[g for g in GATES if not any(s in g for s in ("licens", "licenc", "distrib", "releas"))])


def rules() -> list[tuple[int, str, str, str, str]]:
    """The ordered signature rules: (priority, label, gate words, regex before the gate, regex after it). Sentences come
    before titles, and of alternatives that begin alike the longer stands first. After "licensed under" any title counts;
    after "released", "distributed", "available" or "terms" one that names other things too ("released by MIT",
    "distributed with Python") needs the word "license", or a version where that settles it."""
    out = list(BODIES)
    for label, title, version in FAMILIES:
        forms = _alternatives(title)
        title = "|".join(forms)
        v = f"(?: {version})?" if version else ""
        clear, versioned = ("|".join(f for f in forms if f in some) for some in (CLEAR, VERSIONED))
        named = f"(?:{title}) (?:license|licence){v}"
        if version and versioned:
            named += f"|(?:{versioned}) {version}"
        if clear:
            named += f"|(?:{clear}){v}"
        out.append((label, "license|licence", f"(?:the )?(?:{title})(?: {version})? " if version else f"(?:the )?(?:{title}) ", v))
        out.append((label, "licensed|licenced", "", f" under(?: the)?(?: terms of)?(?: the)? (?:{title})(?: license| licence)?{v}"))
        out.append((label, "released|distributed|available", "", f" (?:under|with)(?: the)?(?: terms of)?(?: the)? (?:{named})"))
        out.append((label, "spdx", "", f" license identifier (?:{title}){v}(?: only| or later)?"))
        out.append((label, "terms", "", f" (?:and conditions )?of the (?:{named})"))
    return [(i, *r) for i, r in enumerate(out + list(GENERAL))]


def _alternatives(title: str) -> list[str]:
    """The alternatives of a regex, those of more words first."""
    parts, depth = [""], 0
    for c in title:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return sorted(parts, key=lambda p: -longest(p))


def longest(regex: str) -> int:
    """The most spaces, and so words, that a rule's regex can match."""
    if not regex:
        return 0

    def of(node) -> int:
        total = 0
        for op, arg in node:
            name = str(op)
            if name == "LITERAL":
                total += arg == 32
            elif name == "BRANCH":
                total += max(of(x) for x in arg[1])
            elif name == "SUBPATTERN":
                total += of(arg[-1])
            elif name == "MAX_REPEAT":
                # A run of letters has no space; whatever else may repeat is bounded.
                total += of(arg[2]) * (int(arg[1]) if of(arg[2]) else 1)
        return total

    return of(sre_parser.parse(regex))


#: Words looked at before and after a gate word: as many as any signature has there.
BEFORE, AFTER = (max(longest(r[k]) for r in rules()) for k in (3, 4))


def _lowered(w: Column) -> Column:
    return F.translate(w, UPPER, LOWER)


def _places(phrase: list[str], label: str) -> Column:
    """Where the phrase's words stand consecutively, found at its last word."""
    head, last, n = " " + " ".join(phrase[:-1]) + " ", phrase[-1], len(phrase) - 1
    ends = F.filter("__x", lambda x: (x["g"] == last) & x["b"].endswith(head))
    return F.transform(ends, lambda x: F.struct((x["i"] - n).cast("long").alias("at"), F.lit(label).alias("label")))


@names_kept
def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, base places, and ``detections``: an array of (first_word, last_word, label, priority).

    The keyword gate is one pass over the text; only documents that pass it are cut into words, and only windows of
    ``BEFORE`` and ``AFTER`` words around a gate word, as long as the longest signature, meet the rules that name it. A
    detection that lies within another of the same or better priority is suppressed, as is a worse one that overlaps a
    better one. Everything is in the row, so there
    is no shuffle and repeated rows each get their own result. Null text counts as empty; without words: 0, nulls and
    empty labels. Columns of ``docs`` named like a result are replaced.
    """
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "detections"]
    df = docs.drop(*[c for c in own if c in docs.columns]).withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("n_words", F.regexp_count("__t", F.lit(WORD)).cast("long"))
    low = F.lower("__t")
    gated = F.lit(False)
    for stem in STEMS:
        gated = gated | low.contains(stem)
    df = df.withColumn("__w", F.when(gated, F.regexp_extract_all("__t", F.lit(WORD), F.lit(0))))
    is_gate = lambda w: _lowered(w).isin(*GATES)
    df = df.withColumn("__g", F.filter(F.transform("__w", lambda w, i: F.when(F.length(w).between(min(map(len, GATES)), max(map(len, GATES))) & is_gate(w), i)), lambda i: i.isNotNull()))
    window = lambda i: F.struct(
        i.alias("i"), _lowered(F.element_at("__w", i + 1)).alias("g"),
        F.concat(F.lit(" "), _lowered(F.array_join(F.slice("__w", F.greatest(i - BEFORE, F.lit(0)) + 1, F.least(i, F.lit(BEFORE))), " ")), F.lit(" ")).alias("b"),
        F.concat(F.lit(" "), _lowered(F.array_join(F.slice("__w", i + 2, F.lit(AFTER)), " ")), F.lit(" ")).alias("a"),
    )
    df = df.withColumn("__x", F.transform("__g", window))
    count = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))  # noqa: E731  words, each with one space

    def found(x: Column) -> Column:
        before, after = x["b"], x["a"]
        hits = []
        for priority, label, gate, left, right in rules():
            named = x["g"].isin(*gate.split("|"))
            lx = f" ({left})$" if left else None
            rx = f"^({right})(?: )" if right else None
            ok = named
            if lx:
                ok = ok & before.rlike(lx)
            if rx:
                ok = ok & after.rlike(rx)
            first = x["i"] - count(F.regexp_extract(before, lx, 1)) if lx else x["i"]
            last = x["i"] + count(F.regexp_extract(after, rx, 1)) if rx else x["i"]
            hits.append(F.when(ok, F.struct(first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), F.lit(label).alias("label"), F.lit(priority).alias("priority"))))
        return F.filter(F.array(*hits), lambda h: h.isNotNull())

    df = df.withColumn("__f", F.transform("__x", found))
    # Detections that meet have gate words that are no further apart; those stand at different words, in order.
    near = BEFORE + AFTER
    beaten = lambda d, e: (e["priority"] < d["priority"]) & (e["first_word"] <= d["last_word"]) & (e["last_word"] >= d["first_word"])
    within = lambda d, e: (e["first_word"] <= d["first_word"]) & (e["last_word"] >= d["last_word"]) & (e["last_word"] - e["first_word"] > d["last_word"] - d["first_word"]) & (e["priority"] <= d["priority"])
    pools = F.transform("__f", lambda own, k: F.struct(own.alias("own"), F.when(F.size(own) > 0, F.flatten(F.slice("__f", F.greatest(k - near, F.lit(0)) + 1, F.lit(2 * near + 1)))).alias("pool")))
    kept = F.transform(pools, lambda p: F.filter(p["own"], lambda d: ~F.exists(p["pool"], lambda e: beaten(d, e) | within(d, e))))
    kept = F.array_sort(F.array_distinct(F.flatten(kept)))
    df = df.withColumn("detections", F.coalesce(kept, F.array().cast("array<struct<first_word:bigint,last_word:bigint,label:string,priority:int>>")))
    places = []
    for phrase, label in BASE:
        places.append(_places(phrase.split(" "), label))
    df = df.withColumn("__p", F.concat(*places))
    df = df.withColumns({
        "n_base": F.coalesce(F.size("__p"), F.lit(0)).cast("long"),
        "first_word": F.array_min(F.transform("__p", lambda p: p["at"])),
        "last_word": F.array_max(F.transform("__p", lambda p: p["at"])),
        "base_labels": F.coalesce(F.array_sort(F.array_distinct(F.transform("__p", lambda p: p["label"]))), F.array().cast("array<string>")),
    })
    df = df.withColumn("n_base", F.when(F.col("__p").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_base")))
    return df.drop("__t", "__w", "__g", "__x", "__f", "__p")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    labels = F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"])))
    words = F.aggregate("detections", F.lit(0).cast("long"), lambda s, d: s + d["last_word"] - d["first_word"] + 1)
    return df.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.least(F.lit(1.0), F.try_divide(words, F.col("n_words"))), F.lit(0.0)).alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )
