"""License scans by ordered signature rules.

Each rule is a regex over the words of a text (lower case, one space between),
with a keyword that gates it, a priority and a weight. Rules run only on texts
that hold their keyword. Of overlapping detections, from left to right, one
that lies within another goes; where they overlap in part, and where they are
equal, the rule of higher priority stays. Signatures of license texts come
first, then machine-readable tags, then names in prose, longer ones first.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fields, lower_ascii

#: Phrases whose places are always reported, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label -> (names in prose, SPDX words); as words, so without punctuation.
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "mit": (("mit", "expat", "x11"), ("mit",)),
    "mit-0": (("mit no attribution", "mit 0"), ("mit 0",)),
    "apache-1.1": (("apache software license version 1 1", "apache 1 1"), ("apache 1 1",)),
    "apache-2": (("apache", "apache 2 0", "apache version 2 0", "apache license version 2 0", "apache license 2 0"), ("apache 2 0",)),
    "bsd-2-clause": (("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"), ("bsd 2 clause",)),
    "bsd-3-clause": (("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"), ("bsd 3 clause",)),
    "bsd-4-clause": (("bsd 4 clause", "4 clause bsd", "original bsd"), ("bsd 4 clause",)),
    "bsd": (("bsd", "bsd style"), ("bsd",)),
    "0bsd": (("zero clause bsd", "0bsd"), ("0bsd",)),
    "gpl-1": (("gnu general public license version 1", "gpl version 1", "gplv1"), ("gpl 1 0", "gpl 1 0 only", "gpl 1 0 or later")),
    "gpl-2": (("gnu general public license version 2", "gpl version 2", "gplv2", "gnu gpl v2"), ("gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later")),
    "gpl-3": (("gnu general public license version 3", "gpl version 3", "gplv3", "gnu gpl v3"), ("gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later")),
    "gpl": (("gnu general public", "general public", "gnu gpl", "gpl"), ("gpl",)),
    "lgpl-2.1": (("gnu lesser general public license version 2 1", "lgpl version 2 1", "lgplv2 1"), ("lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later")),
    "lgpl-3": (("gnu lesser general public license version 3", "lgpl version 3", "lgplv3"), ("lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later")),
    "lgpl": (("gnu lesser general public", "lesser general public", "gnu library general public", "lgpl"), ("lgpl",)),
    "agpl-3": (("gnu affero general public license version 3", "agpl version 3", "agplv3", "affero gpl"), ("agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later")),
    "mpl-1.1": (("mozilla public license version 1 1", "mpl 1 1"), ("mpl 1 1",)),
    "mpl-2": (("mozilla public", "mozilla public license version 2 0", "mpl 2 0", "mpl"), ("mpl 2 0",)),
    "epl-1": (("eclipse public license version 1 0", "epl 1 0"), ("epl 1 0",)),
    "epl-2": (("eclipse public", "eclipse public license version 2 0", "epl 2 0"), ("epl 2 0",)),
    "cddl-1": (("common development and distribution", "cddl"), ("cddl 1 0",)),
    "eupl-1.2": (("european union public", "eupl"), ("eupl 1 2",)),
    "artistic-2": (("artistic license 2 0", "artistic", "perl artistic"), ("artistic 2 0",)),
    "boost-1": (("boost software", "boost software license version 1 0"), ("bsl 1 0",)),
    "isc": (("isc", "internet systems consortium"), ("isc",)),
    "zlib": (("zlib", "zlib libpng"), ("zlib",)),
    "unlicense": (("unlicense",), ("unlicense",)),
    "wtfpl": (("do what the fuck you want to public", "wtfpl"), ("wtfpl",)),
    "cc0-1": (("cc0", "cc0 1 0", "creative commons zero"), ("cc0 1 0",)),
    "cc-by": (("cc by", "creative commons attribution"), ("cc by 4 0", "cc by 3 0")),
    "cc-by-sa": (("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), ("cc by sa 4 0", "cc by sa 3 0")),
    "cc-by-nd": (("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"), ("cc by nd 4 0",)),
    "cc-by-nc": (("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"), ("cc by nc 4 0", "cc by nc 3 0")),
    "cc-by-nc-sa": (("cc by nc sa", "creative commons attribution noncommercial sharealike"), ("cc by nc sa 4 0",)),
    "cc-by-nc-nd": (("cc by nc nd", "creative commons attribution noncommercial noderivatives"), ("cc by nc nd 4 0",)),
    "ofl-1.1": (("sil open font", "open font"), ("ofl 1 1",)),
    "python-2": (("python software foundation", "psf"), ("psf 2 0", "python 2 0")),
    "odbl-1": (("open database", "odbl"), ("odbl 1 0",)),
    "gfdl": (("gnu free documentation", "free documentation"), ("gfdl 1 3",)),
    "sspl-1": (("server side public", "sspl"), ("sspl 1 0",)),
    "proprietary": (("proprietary", "commercial"), ()),
}
#: (phrase before and after a name, weight); {} is the name.
PHRASES = (
    (r"(?:licen[sc]ed|released|distributed|available|published|provided|made available) under (?:the )?(?:terms of )?(?:the )?{}(?: licen[sc]e)?", 0.95),
    (r"(?:subject to|covered by|governed by) (?:the )?(?:terms of )?(?:the )?{}(?: licen[sc]e)?", 0.9),
    (r"{} licen[sc]e", 0.8),
)
#: Names that are also ordinary words: they count after words such as "licensed under" alone, not before "license".
ORDINARY = ("artistic", "commercial", "proprietary", "general public", "free documentation", "open database", "open font", "bsd style", "x11", "unlicense")
#: A text is looked at only if it holds one of these; each keyword of a signature holds one, and so does each other rule's regex.
GATES = (
    "licen", "spdx", "released under", "distributed under", "available under", "published under", "provided under", "subject to", "covered by", "governed by",
    "permission", "redistribution", "free software foundation", "gnu org", "creativecommons org", "opensource org", "mozilla org", "public domain", "all rights reserved",
    "unencumbered", "as is", "copyright", "confidential", "royalty free", "apache software foundation", "apache org", "boost org", "unlicense org", "advertising materials", "contents of this file", "accompanying", "terms as perl",
    "prior written", "for good not evil", "openssl project", "jpeg group", "freetype project", "sil org ofl", "open rail m", "unauthorized copying", "cc by nc",
)
#: Sentences and addresses of license texts: (label, keyword, regex, weight), in order of priority.
TEXTS = (
    ("mit-0", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software", 1.0),
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "above copyright notice and this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1.0),
    ("mit", "opensource org licenses mit", r"opensource org licenses mit", 1.0),
    ("boost-1", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy", 1.0),
    ("boost-1", "boost org license", r"boost org license 1 0", 1.0),
    ("boost-1", "boost software license", r"distributed under the boost software license", 1.0),
    ("apache-2", "apache org licenses", r"(?:www )?apache org licenses license 2 0", 1.0),
    ("apache-2", "you may not use this file except in compliance with the license", r"you may not use this file except in compliance with the license", 0.9),
    ("apache-2", "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("apache-2", "royalty free irrevocable", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license", 1.0),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 0.9),
    ("bsd-4-clause", "advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.9),
    ("bsd-3-clause", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.{0,900}neither the name", 1.0),
    ("bsd-2-clause", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions.{0,500}2 redistributions.{0,300}this software is provided", 1.0),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.9),
    ("bsd", "opensource org licenses bsd", r"opensource org licenses bsd", 1.0),
    ("bsd-3-clause", "specific prior written permission", r"used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("0bsd", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software", 1.0),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("isc", "permission to use copy modify", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided", 1.0),
    ("hpnd", "permission to use copy modify", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose", 1.0),
    ("ntp", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee", 1.0),
    ("zlib", "as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1.0),
    ("zlib", "permission is granted to anyone", r"permission is granted to anyone to use this software for any purpose including commercial applications", 1.0),
    ("unlicense", "unencumbered software", r"(?:this is )?free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "unlicense org", r"(?:www )?unlicense org", 0.9),
    ("wtfpl", "license", r"do what the fuck you want to public license", 1.0),
    ("beerware", "copyright", r"the beer ware license", 1.0),
    ("jsonlic", "for good not evil", r"the software shall be used for good not evil", 1.0),
    ("gpl-2", "gnu general public license", r"gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 1.0),
    ("gpl-2", "gnu general public license", r"gnu general public license version 2(?: only| as published by the free software foundation)?", 1.0),
    ("gpl-3", "gnu general public license", r"gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 1.0),
    ("gpl-3", "gnu general public license", r"gnu general public license version 3(?: only| as published by the free software foundation)?", 1.0),
    ("gpl", "gnu general public license", r"(?:this program is )?free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("gpl", "copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with", 0.95),
    ("gpl", "gnu general public license", r"see the gnu general public license for more details", 0.9),
    ("gpl", "gnu org licenses", r"gnu org licenses gpl", 0.9),
    ("gpl", "free software foundation", r"published by the free software foundation", 0.6),
    ("lgpl-2.1", "gnu lesser general public license", r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license", 1.0),
    ("lgpl-3", "gnu lesser general public license", r"gnu lesser general public license as published by the free software foundation either version 3 of the license", 1.0),
    ("lgpl", "gnu library general public license", r"gnu library general public license as published by the free software foundation", 1.0),
    ("lgpl", "copy of the gnu lesser general public license", r"you should have received a copy of the gnu lesser general public license along with", 0.95),
    ("lgpl", "gnu org licenses", r"gnu org licenses lgpl", 0.9),
    ("agpl-3", "gnu affero general public license", r"gnu affero general public license as published by the free software foundation(?: either version 3)?", 1.0),
    ("agpl-3", "copy of the gnu affero general public license", r"you should have received a copy of the gnu affero general public license along with", 0.95),
    ("agpl-3", "gnu org licenses", r"gnu org licenses agpl", 0.9),
    ("gfdl", "gnu free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("gfdl", "gnu org licenses", r"gnu org licenses fdl", 0.9),
    ("mpl-2", "mozilla public license", r"this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2", "mozilla org mpl", r"mozilla org mpl 2 0", 1.0),
    ("mpl-1.1", "mozilla public license", r"the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl-1.0", "mozilla public license", r"the contents of this file are subject to the mozilla public license version 1 0", 1.0),
    ("mpl-1.1", "mozilla org mpl", r"mozilla org mpl mpl 1 1", 1.0),
    ("npl-1.1", "netscape public license", r"the contents of this file are subject to the netscape public license version 1 1", 1.0),
    ("epl-1", "eclipse public license", r"accompanying materials are made available under the terms of the eclipse public license v1 0", 1.0),
    ("epl-2", "eclipse public license", r"accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0", 1.0),
    ("cddl-1", "common development and distribution license", r"the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("cpl-1", "common public license", r"accompanying program is provided under the terms of this common public license", 1.0),
    ("ipl-1", "ibm public license", r"accompanying program is provided under the terms of this ibm public license", 1.0),
    ("eupl-1.2", "licensed under the eupl", r"licensed under the eupl(?: version 1 2)?", 1.0),
    ("cecill-2", "cecill license", r"governed by the cecill license under french law", 1.0),
    ("artistic-2", "artistic license", r"(?:under the terms of|licensed under|under) the artistic license(?: version)? 2 0", 1.0),
    ("artistic-1", "artistic license", r"terms of (?:either the perl 5 )?artistic license(?: version 1 0)?", 0.9),
    ("perl", "terms as perl", r"you can redistribute it and or modify it under the same terms as perl(?: itself| 5)?", 0.9),
    ("python-2", "python software foundation license", r"python software foundation license version 2", 1.0),
    ("python-2", "copyright", r"copyright c 2001 .{0,60}python software foundation all rights reserved", 1.0),
    ("ruby", "ruby license", r"same terms as the ruby license|under the terms of the ruby license", 0.9),
    ("php-3.01", "php license", r"this source file is subject to version 3 01 of the php license", 1.0),
    ("postgresql", "postgresql license", r"released under the postgresql license|under the postgresql license", 1.0),
    ("postgresql", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project", 0.9),
    ("curl", "copyright", r"copyright c 1996 .{0,40}daniel stenberg", 0.9),
    ("x11", "without prior written authorization", r"except as contained in this notice the name.{0,60}shall not be used in advertising or otherwise to promote the sale.{0,60}without prior written authorization", 0.9),
    ("libpng", "libpng license", r"(?:this code is released under|see) the libpng license", 1.0),
    ("ijg", "jpeg group", r"this software is based in part on the work of the independent jpeg group", 0.9),
    ("freetype", "freetype project", r"portions of this software are copyright.{0,30}the freetype project", 1.0),
    ("ofl-1.1", "sil open font license", r"this font software is licensed under the sil open font license version 1 1", 1.0),
    ("ofl-1.1", "sil org ofl", r"scripts sil org ofl", 0.9),
    ("odbl-1", "open data commons open database license", r"made available under the open data commons open database license", 1.0),
    ("odc-by-1", "open data commons attribution license", r"made available under the open data commons attribution license", 1.0),
    ("pddl-1", "public domain dedication and license", r"open data commons public domain dedication and license", 1.0),
    ("cdla-permissive-2", "community data license agreement", r"community data license agreement permissive(?: version)? 2 0", 1.0),
    ("cdla-sharing-1", "community data license agreement", r"community data license agreement sharing(?: version)? 1 0", 1.0),
    ("ogl-uk-3", "open government licence", r"contains public sector information licensed under the open government licence v3 0", 1.0),
    ("ogl-uk", "open government licence", r"(?:under|of) the open government licence", 0.9),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd", 1.0),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa", 1.0),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [0-9]", 1.0),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd", 1.0),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa", 1.0),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by [0-9]", 1.0),
    ("cc0-1", "creativecommons org", r"creativecommons org publicdomain zero", 1.0),
    ("pdm-1", "creativecommons org", r"creativecommons org publicdomain mark", 1.0),
    ("cc-by-nc-nd", "license", r"creative commons attribution non ?commercial no ?deriv(?:atives|s) [0-9] [0-9] (?:international|unported|generic) license", 1.0),
    ("cc-by-nc-sa", "license", r"creative commons attribution non ?commercial share ?alike [0-9] [0-9] (?:international|unported|generic) license", 1.0),
    ("cc-by-nc", "license", r"creative commons attribution non ?commercial [0-9] [0-9] (?:international|unported|generic) license", 1.0),
    ("cc-by-sa", "license", r"creative commons attribution share ?alike [0-9] [0-9] (?:international|unported|generic) license", 1.0),
    ("cc-by-nd", "license", r"creative commons attribution no ?deriv(?:atives|s) [0-9] [0-9] (?:international|unported|generic) license", 1.0),
    ("cc-by", "license", r"creative commons attribution [0-9] [0-9] (?:international|unported|generic) license", 1.0),
    ("cc0-1", "public domain dedication", r"cc0 1 0 universal public domain dedication", 1.0),
    ("cc0-1", "copyright and related", r"to the extent possible under law.{0,80}has waived all copyright and related or neighboring rights", 1.0),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 0.9),
    ("public-domain", "disclaims copyright", r"the author disclaims copyright to this source code", 1.0),
    ("bsl-1.1", "business source license", r"(?:licensed under|use of this software is governed by|parameters) the business source license(?: 1 1)?", 1.0),
    ("sspl-1", "server side public license", r"under the terms of the server side public license version 1", 1.0),
    ("elastic-2", "elastic license", r"licensed under the elastic license(?: 2 0)?", 1.0),
    ("commons-clause", "commons clause license", r"commons clause license condition v1 0", 1.0),
    ("rail-m", "open rail m", r"(?:creativeml|bigscience|bigcode) open rail m", 1.0),
    ("llama-community", "community license agreement", r"llama [0-9](?: [0-9])? community license agreement", 1.0),
    ("ms-pl", "microsoft public license", r"(?:under|subject to|see) the microsoft public license", 1.0),
    ("ms-rl", "microsoft reciprocal license", r"(?:under|subject to|see) the microsoft reciprocal license", 1.0),
    ("osl-3", "open software license", r"licensed under the open software license version 3 0", 1.0),
    ("afl-3", "academic free license", r"licensed under the academic free license version 3 0", 1.0),
    ("ncsa", "open source license", r"university of illinois (?:ncsa )?open source license", 1.0),
    ("upl-1", "universal permissive license", r"licensed under the universal permissive license v 1 0", 1.0),
    ("mulan-psl-2", "licensed under mulan", r"licensed under mulan psl v2", 1.0),
    ("vim", "vim license", r"(?:under|see) the vim license", 0.9),
    ("qpl-1", "q public license", r"under the terms of the q public license", 1.0),
    ("sleepycat", "sleepycat license", r"(?:under|see) the sleepycat license", 0.9),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary(?: information)?", 0.8),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", 0.9),
    ("proprietary", "without permission", r"(?:may not be|no part of this (?:work|publication|document) may be) (?:copied|reproduced|republished)(?: or (?:distributed|transmitted))?.{0,80}without (?:the )?(?:prior )?(?:written )?permission", 0.8),
    ("proprietary", "end user license agreement", r"(?:by using this software you agree to|subject to) the (?:terms of the )?end user license agreement", 0.8),
    ("proprietary", "all rights reserved", r"all rights reserved", 0.5),
)


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, regex, weight): texts first, then SPDX tags, then phrases; longer names before shorter ones."""
    found = [(label, keyword, regex, weight) for label, keyword, regex, weight in TEXTS]
    found += [(label, "spdx", rf"spdx license identifier {tag}", 1.0) for label, (_, tags) in FAMILIES.items() for tag in sorted(tags, key=len, reverse=True)]
    named = sorted(((n, label) for label, (names, _) in FAMILIES.items() for n in names), key=lambda x: (-len(x[0]), x[0]))
    bare = PHRASES[-1][0]
    found += [(label, n, phrase.format(n), weight) for phrase, weight in PHRASES for n, label in named if phrase != bare or n not in ORDINARY]
    found += [(label, words, words, 0.9) for words, label in BASE]
    return [(k, *rule) for k, rule in enumerate(found)]


def license_words(text: Column) -> Column:
    """The words of a text in lower case, one space between."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _detections(padded: Column) -> Column:
    """Array of (start, end, priority, label, weight) of the rules whose keyword occurs, in characters of padded."""
    by_keyword: dict[str, list[Column]] = {}
    for p, label, k, r, w in rules():
        by_keyword.setdefault(k, []).append(F.struct(F.lit(p).alias("p"), F.lit(label).alias("label"), F.lit(f"(?<= ){r}(?= )").alias("r"), F.lit(w).alias("w")))
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*own).alias("rules")) for k, own in by_keyword.items()])

    def places(rule: Column) -> Column:
        found, between = F.regexp_extract_all(padded, rule["r"], F.lit(0)), F.split(padded, rule["r"])
        start = F.aggregate(
            F.arrays_zip(between.alias("b"), found.alias("m")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
            lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(
                F.struct(
                    (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
                    F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["b"])).alias("s"), (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("e")))).alias("out"),
                )
            ),
        )["out"]
        return F.transform(start, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), rule["p"].alias("p"), rule["label"].alias("label"), rule["w"].alias("w")))

    named = F.flatten(F.transform(F.filter(every, lambda group: F.contains(padded, group["k"])), lambda group: group["rules"]))
    kept = F.filter(named, lambda r: F.rlike(padded, r["r"]))
    return F.array_sort(F.flatten(F.transform(kept, places)))


def _settled(found: Column) -> Column:
    """Labels and largest weight of the detections that stay. They come in order of start, falling end and priority; each meets the last one that stayed."""
    none = F.array().cast("array<string>")
    state = lambda until, p, label, w, labels, score: F.struct(until.alias("until"), p.alias("p"), label.alias("label"), w.alias("w"), labels.alias("labels"), score.alias("score"))
    # labels and score are of those that no later detection can touch.
    start = state(F.lit(-1), F.lit(-1), F.lit(None).cast("string"), F.lit(0.0), none, F.lit(0.0))
    closed = lambda acc: (F.when(acc["label"].isNull(), acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(acc["label"]))), F.greatest(acc["score"], acc["w"]))
    replaced = lambda acc, x: state(-x["ne"], x["p"], x["label"], x["w"], acc["labels"], acc["score"])
    return F.aggregate(
        found,
        start,
        lambda acc, x: F.when(x["s"] >= acc["until"], state(-x["ne"], x["p"], x["label"], x["w"], *closed(acc))).when((-x["ne"] > acc["until"]) & (x["p"] < acc["p"]), replaced(acc, x)).otherwise(acc),
        lambda acc: F.struct(closed(acc)[0].alias("labels"), closed(acc)[1].alias("score")),
    )


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of the BASE phrases, ``first_word`` and
    ``last_word`` are the smallest and largest index of a word where one starts
    (null without any); ``labels`` joins the base labels and the rules' own;
    ``score`` is the largest weight of a detection, 0 without any.

    Null and empty texts have no words, no labels and score 0. A text is looked
    at whole, however long. Repeated rows give repeated results. An empty table gives no rows. Other columns are
    ignored. All work is done within a row, so no group can be hot.
    """
    rows = fields(docs, doc_id=doc_id, text=text).select("doc_id", F.concat(F.lit(" "), license_words(F.col("text")), F.lit(" ")).alias("padded"))
    padded, gated = F.col("padded"), F.col("gated")
    rows = rows.withColumn("gated", reduce(or_, (F.contains(padded, F.lit(k)) for k in GATES)))
    phrases = [(f" {words} ", label) for words, label in BASE]
    has = [F.contains(padded, F.lit(words)) for words, _ in phrases]
    base = F.struct(
        sum((F.regexp_count(padded, F.lit(f"(?<= ){w.strip()}(?= )")) for w, _ in phrases), F.lit(0)).alias("n"),
        F.least(*[F.when(h, _spaces(F.substr(padded, F.lit(1), F.instr(padded, w)))) for h, (w, _) in zip(has, phrases, strict=True)]).alias("first"),
        F.greatest(*[F.when(h, _spaces(F.substr(padded, F.lit(1), F.length(padded) - F.instr(F.reverse(padded), w[::-1]) - F.lit(len(w) - 2)))) for h, (w, _) in zip(has, phrases, strict=True)]).alias("last"),
        F.array_compact(F.array(*[F.when(h, F.lit(label)) for h, (_, label) in zip(has, phrases, strict=True)])).alias("labels"),
    )
    rows = rows.select(
        "doc_id",
        F.when(padded == "  ", 0).otherwise(_spaces(padded) - 1).cast("long").alias("n_words"),
        F.when(gated, base).alias("base"),
        F.when(gated, _settled(_detections(padded))).alias("found"),
    )
    none = F.array().cast("array<string>")
    labels, own = F.coalesce("base.labels", none), F.coalesce("found.labels", none)
    score = F.coalesce("found.score", F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("base.n", F.lit(0)).cast("long").alias("n_base"),
        (F.col("base.first") - 1).cast("long").alias("first_word"),
        (F.col("base.last") - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, own)), ",").alias("labels"),
        F.when(F.size(labels) > 0, F.greatest(score, F.lit(0.9))).otherwise(score).alias("score"),
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


