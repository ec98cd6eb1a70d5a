"""License scan: ordered signature rules over a text's words. DataFrame expressions only.

Words are runs of digits, lower-cased ASCII letters and non-ASCII characters. Fixed phrases are looked up as consecutive words;
their places and labels always count. Beside them stand the rules below: regexes over the words joined by single spaces, each
with a keyword that the text must contain before the regex runs, a priority and a confidence. Of overlapping detections, one
that lies within another of the same or a better priority goes (of equal ones the rule listed first stays), so "gnu lesser
general public license version 3" is not also "some gnu license".

score is the highest confidence of what was found, 0 without any. Null texts count as empty; a text without words has no
places. Repeated rows get the same answer. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import text_or_empty
from hearthline.llm.spans import bound

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Families: label, keyword, the license's name as a regex over words. Each gives rules of the forms in FORMS.
FAMILIES = (
    ("gpl-1.0", "gnu", r"gnu (?:general public licen[sc]e|gpl)(?: version| v)? ?1(?: 0)?"),
    ("gpl-2.0", "gnu", r"gnu (?:general public licen[sc]e|gpl)(?: version| v)? ?2(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu (?:general public licen[sc]e|gpl)(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.0", "gnu", r"gnu (?:library|lesser) general public licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("lgpl-2.1", "gnu", r"gnu lesser general public licen[sc]e(?: version| v)? ?2 1"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public licen[sc]e(?: version| v)? ?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?: version| v)?(?: ?3(?: 0)?)?"),
    ("gfdl-1.3", "free documentation", r"gnu free documentation licen[sc]e(?: version| v)?(?: ?1 [123])?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e(?: version| v)? ?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("mit", "mit", r"mit licen[sc]e"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e(?: version| v)?(?: ?1(?: 0)?)?"),
    ("cpl-1.0", "common public", r"common public licen[sc]e(?: version| v)?(?: ?1(?: 0)?)?"),
    ("eupl-1.2", "european union", r"european union public licen[sc]e(?: version| v)?(?: ?1 2)?"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e(?: version| v)? ?1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: version| v)? ?2(?: 0)?"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: version| v)?(?: ?1(?: 0)?)?"),
    ("busl-1.1", "business source", r"business source licen[sc]e(?: version| v)?(?: ?1 1)?"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e(?: version| v)?(?: ?1)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e(?: version| v)?(?: ?2)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version| v)?(?: ?2)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-4.0", "cc by", r"cc by 4 0"),
    ("cc-by-3.0", "cc by", r"cc by 3 0"),
    ("cc-by-2.0", "cc by", r"cc by 2 [05]"),
    ("cc-by-sa-4.0", "cc by sa", r"cc by sa 4 0"),
    ("cc-by-sa-3.0", "cc by sa", r"cc by sa 3 0"),
    ("cc-by-nc-4.0", "cc by nc", r"cc by nc 4 0"),
    ("cc-by-nc-3.0", "cc by nc", r"cc by nc 3 0"),
    ("cc-by-nd-4.0", "cc by nd", r"cc by nd 4 0"),
    ("cc-by-nd-3.0", "cc by nd", r"cc by nd 3 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", r"cc by nc nd 4 0"),
    ("cc-by-4.0", "creative commons", r"creative commons attribution 4 0(?: international)?"),
    ("cc-by-sa-4.0", "creative commons", r"creative commons attribution share ?alike 4 0(?: international)?"),
    ("cc-by-nc-4.0", "creative commons", r"creative commons attribution non ?commercial 4 0(?: international)?"),
    ("cc-by-nd-4.0", "creative commons", r"creative commons attribution no ?derivatives 4 0(?: international)?"),
    ("odbl-1.0", "open database", r"open database licen[sc]e(?: version| v)?(?: ?1(?: 0)?)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[sc]e"),
    ("pddl-1.0", "open data commons", r"open data commons public domain dedication and licen[sc]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: version| v)?(?: ?1 1)?"),
    ("psf-2.0", "python software", r"python software foundation licen[sc]e(?: version| v)?(?: ?2)?"),
    ("php-3.01", "php", r"php licen[sc]e(?: version| v)?(?: ?3 0?1)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e(?: version| v)?(?: ?1(?: 0)?)?"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[sc]e"),
    ("x11", "x11", r"(?:x11|mit x11) licen[sc]e"),
    ("afl-3.0", "academic free", r"academic free licen[sc]e(?: version| v)?(?: ?3(?: 0)?)?"),
    ("osl-3.0", "open software", r"open software licen[sc]e(?: version| v)?(?: ?3(?: 0)?)?"),
    ("qpl-1.0", "q public", r"q public licen[sc]e"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: version| v)?(?: ?2(?: 0)?)?"),
    ("openrail", "rail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)?"),
    ("llama", "llama", r"llama (?:2 |3 )?community licen[sc]e"),
    ("json", "json", r"json licen[sc]e"),
)

_GNU, _V = r"(?: only| or later| plus)?", r" ?(?:v ?|version )?"

#: SPDX identifiers of the families as regexes over words.
SPDX = {
    **{f"gpl-{v}.0": rf"gpl {v} 0{_GNU}" for v in (1, 2, 3)},
    **{f"lgpl-{v}": rf"lgpl {v.replace('.', ' ')}{_GNU}" for v in ("2.0", "2.1", "3.0")},
    "agpl-3.0": rf"agpl 3 0{_GNU}",
    "gfdl-1.3": rf"gfdl 1 [123](?: no invariants| invariants)?{_GNU}",
    **{name: name.replace("-", " ").replace(".", " ") for name in ("apache-1.1", "apache-2.0", "mit", "mit-0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "isc", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0")},
    **{name: name.replace("-", " ").replace(".", " ") for name in ("cddl-1.0", "cpl-1.0", "eupl-1.2", "artistic-2.0", "bsl-1.0", "busl-1.1", "sspl-1.0", "zlib", "unlicense", "wtfpl", "cc0-1.0", "pddl-1.0")},
    **{name: name.replace("-", " ").replace(".", " ") for name in ("odbl-1.0", "odc-by-1.0", "php-3.01", "ms-pl", "ms-rl", "ncsa", "postgresql", "openssl", "upl-1.0", "vim", "x11", "afl-3.0", "osl-3.0", "qpl-1.0", "elastic-2.0", "json")},
    **{name: name.replace("-", " ").replace(".", " ") for name in ("cc-by-4.0", "cc-by-3.0", "cc-by-sa-4.0", "cc-by-sa-3.0", "cc-by-nc-4.0", "cc-by-nc-3.0", "cc-by-nd-4.0", "cc-by-nd-3.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0")},
    "cc-by-2.0": "cc by 2 [05]",
    "artistic-1.0": "artistic 1 0(?: perl| cl8)?",
    "libpng": "libpng(?: 2 0)?",
    "ofl-1.1": "ofl 1 1(?: no rfn| rfn)?",
    "psf-2.0": "(?:psf 2 0|python 2 0(?: 1)?)",
    "w3c": "w3c(?: 19980720| 20150513)?",
}
_ANY_SPDX = "(?:" + "|".join(sorted(set(SPDX.values()), key=lambda r: (-len(r), r))) + ")(?: with(?: [a-z0-9]+){1,4} exception(?: [0-9]+){0,2})?"

#: Short forms of the names: label, keyword, regex.
SHORT = (
    *((f"gpl-{v}.0", "gpl", rf"(?:gnu )?gpl{_V}{v}(?: 0)?{_GNU}") for v in (1, 2, 3)),
    *((f"lgpl-{v}.0", "lgpl", rf"(?:gnu )?lgpl{_V}{v}(?: 0)?{_GNU}") for v in (2, 3)),
    ("lgpl-2.1", "lgpl", rf"(?:gnu )?lgpl{_V}2 1{_GNU}"),
    ("agpl-3.0", "agpl", rf"(?:gnu )?agpl{_V}3(?: 0)?{_GNU}"),
    ("apache-1.1", "apache", rf"apache{_V}1 1"),
    ("apache-2.0", "apache", rf"(?:apache{_V}2 0|apache ?v ?2|apache 2 licen[sc]ed?)"),
    ("mpl-1.1", " mpl", rf"mpl{_V}1 1"),
    ("mpl-2.0", " mpl", rf"mpl{_V}2(?: 0)?"),
    ("epl-1.0", " epl", rf"epl{_V}1(?: 0)?"),
    ("epl-2.0", " epl", rf"epl{_V}2(?: 0)?"),
    ("cddl-1.0", "cddl", rf"cddl{_V}1(?: 0)?"),
    ("eupl-1.2", "eupl", rf"eupl{_V}1 2"),
    ("bsl-1.0", " bsl", rf"bsl{_V}1 0"),
    ("busl-1.1", "busl", rf"busl{_V}1 1"),
    ("sspl-1.0", "sspl", rf"sspl{_V}1(?: 0)?"),
    ("ofl-1.1", " ofl", rf"(?:sil )?ofl{_V}1 1"),
    ("odbl-1.0", "odbl", rf"odbl{_V}1(?: 0)?"),
)

#: How a license is given: form, regex around the name (%s), priority (lower is better), confidence.
FORMS = (
    ("grant", r"(?:licensed|released|distributed|available|published|provided|made available|redistribute it|modify it) (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:an? )?%s", 1, 0.95),
    ("spdx", r"spdx license identifier %s", 0, 1.0),  # of the identifier too, and behind another one in an expression
    ("name", r"%s", 3, 0.7),
)

#: Rules that stand alone: label, keyword, regex, priority, confidence.
SINGLE = (
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 4, 0.6),
    ("copyright-notice", "copyright", r"copyright (?:c |© )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 5, 0.4),
    ("copyright-notice", "copyright", r"(?:c|©) copyright", 5, 0.4),
    ("proprietary", "proprietary", r"proprietary and confidential", 4, 0.7),
    ("proprietary", "prohibited", r"(?:unauthorized|unauthorised) (?:copying|reproduction|use|distribution)(?: [a-z]+){0,6} (?:is )?(?:strictly )?prohibited", 4, 0.7),
    ("proprietary", "may not be", r"may not be (?:reproduced|copied|distributed)(?: [a-z]+){0,8} without (?:the )?(?:prior )?(?:express )?written", 4, 0.7),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain", 3, 0.8),
    ("public-domain", "public domain", r"public domain dedication", 3, 0.8),
    ("mit-text", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 1, 0.95),
    ("isc-text", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 1, 0.95),
    ("bsd-text", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 1, 0.95),
    ("gpl-text", "free software", r"this program is free software you can redistribute it and or modify it", 1, 0.95),
    ("gpl-text", "without even the implied", r"without even the implied warranty of merchantability", 2, 0.6),
    ("as-is-text", "provided as is", r"(?:software|work|material) is provided as is", 3, 0.6),
    ("apache-text", "obtain a copy of the", r"you may obtain a copy of the license at", 2, 0.7),
    ("apache-text", "use this file except", r"you may not use this file except in compliance with the license", 1, 0.95),
    ("mpl-text", "source code form", r"this source code form is subject to the terms of the mozilla public license", 0, 1.0),
    ("unlicense-text", "unencumbered", r"this is free and unencumbered software released into the public domain", 0, 1.0),
    ("cc-by-nc", "cc by nc", r"cc by nc", 2, 0.8),
    ("cc-by-sa", "cc by sa", r"cc by sa", 2, 0.8),
    ("cc-by-nd", "cc by nd", r"cc by nd", 2, 0.8),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa", 1, 0.85),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd", 1, 0.85),
    ("cc", "creativecommons", r"creativecommons org (?:licenses|publicdomain)(?: [a-z]+){1,3} [0-9] [0-9]", 2, 0.9),
    ("cc", "creative commons", r"creative commons(?: [a-z]+){0,4} licen[sc]e", 3, 0.7),
    ("license-url", "opensource org", r"opensource org licenses? [a-z0-9 ]{2,20}", 3, 0.7),
    ("license-url", "gnu org", r"gnu org licen[sc]es [a-z0-9 ]{2,12}", 3, 0.7),
    ("license-url", "apache org", r"apache org licenses license [0-9] [0-9]", 2, 0.8),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[sc]e", 3, 0.75),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", 4, 0.7),
    ("gpl", "gnu gpl", r"gnu gpl", 4, 0.7),
    ("licensed", "licensed under", r"licensed under", 6, 0.3),
)

RULES = tuple(
    (label, keyword, regex, priority, confidence)
    for label, keyword, regex, priority, confidence in [
        *((label, keyword, form % f"(?:{name})", priority, confidence) for label, keyword, name in FAMILIES for _, form, priority, confidence in FORMS),
        *SINGLE,
        *((label, keyword, form % f"(?:{name})", priority, confidence) for label, keyword, name in SHORT for kind, form, priority, confidence in FORMS if kind != "spdx"),
        *((label, "licen", form % name, priority, confidence) for label, name in (("mit", "mit"), ("isc", "isc")) for form, priority, confidence in ((r"licen[sc]ed under (?:the )?(?:terms of )?(?:the )?%s", 1, 0.95), (r"%s licen[sc]ed", 3, 0.7))),
        *((label, "spdx license identifier", rf"spdx license identifier (?:{name})", 0, 1.0) for label, name in SPDX.items()),
        *((label, "spdx license identifier", rf"{_ANY_SPDX} (?:or|and) (?:{name})", 0, 1.0) for label, name in SPDX.items()),
    ]
)

#: No rule and no phrase can match a text without one of these. Ordered by how often they decide.
GATE = (
    "licen", "copyright", "reserved", "creative commons", "creativecommons", "public domain", "cc by", "cc0", "prohibited", "redistribut",
    "permission", "proprietary", "gnu", "openrail", "open rail", "bsd", "wtfpl", "spdx", "provided as is", "may not be", "warranty",
    "mit no attribution", "\u00a9 ", "opensource", "obtain a copy", "use this file", "source code form",
    "gpl", "apache", " mpl", " epl", "cddl", "eupl", " bsl", "busl", "sspl", " ofl", "odbl",
)

_DETECTION = "struct<rule:int,label:string,start:int,end:int,priority:int,confidence:double>"


def places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand one after the other."""
    parts = phrase.split(" ")

    def here(words, i):
        same = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == part)
        return same

    def found(words):
        starts = F.sequence(F.lit(0), F.size(words) - len(parts))
        return F.when(F.size(words) >= len(parts), F.filter(starts, lambda i: here(words, i))).otherwise(F.array().cast("array<int>"))

    return bound(words, found)


def detections(joined: Column, rules: Column) -> Column:
    """What the rules find in words joined, begun and ended by single spaces, with spans in its characters; nothing suppressed yet."""

    def found_by(rule):
        pattern = F.concat(F.lit("(?<= )"), rule["regex"], F.lit("(?= )"))
        between, hits = F.split(joined, pattern, -1), F.regexp_extract_all(joined, pattern, F.lit(0))
        pairs = F.zip_with(between, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n")))

        def step(state, pair):
            start = state["at"] + pair["gap"]
            item = F.struct(rule["rule"].alias("rule"), rule["label"].alias("label"), start.alias("start"), (start + pair["n"]).alias("end"), rule["priority"].alias("priority"), rule["confidence"].alias("confidence"))
            return F.when(pair["n"].isNull(), state).otherwise(F.struct((start + pair["n"]).alias("at"), F.concat(state["out"], F.array(item)).alias("out")))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_DETECTION}>").alias("out")), step, lambda s: s["out"])

    return F.flatten(F.transform(F.filter(rules, lambda r: joined.contains(r["keyword"])), found_by))


def resolved(found: Column) -> Column:
    """Without detections that lie within another one of the same or a better priority."""

    def beaten(d, e):
        within = (e["start"] <= d["start"]) & (e["end"] >= d["end"])
        same_span = (e["start"] == d["start"]) & (e["end"] == d["end"])
        better = (e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & (~same_span | (e["rule"] < d["rule"])))
        return within & better

    return bound(found, lambda all_found: F.filter(all_found, lambda d: ~F.exists(all_found, lambda e: beaten(d, e))))


def rules_column() -> Column:
    kind = "array<struct<rule:int,label:string,keyword:string,regex:string,priority:int,confidence:double>>"
    return F.array(*[F.struct(F.lit(i).alias("rule"), *[F.lit(v).alias(n) for n, v in zip(("label", "keyword", "regex", "priority", "confidence"), r, strict=True)]) for i, r in enumerate(RULES)]).cast(kind)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: the id, n_words, base (array of word, label), found (array of detections, spans in the joined words)."""
    # lower() changes non-ASCII letters too, which moves no word's border: only of U+212A and U+0130 it makes ASCII letters
    text = text_or_empty(text_column)
    lower = F.lower(F.when(text.contains("\u212a") | text.contains("\u0130"), F.translate(text, "\u212a\u0130", "\u00e9\u00e9")).otherwise(text))
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NOT_WORD, " ")), F.lit(" "))
    slim = docs.select(docs[id_column], F.explode(F.array(joined)).alias("joined"))  # made once, whatever reads it
    length = F.length("joined")
    slim = slim.withColumn("n_words", F.when(length <= 2, F.lit(0)).otherwise(length - F.length(F.replace("joined", F.lit(" "), F.lit(""))) - 1).cast("long"))
    gated = reduce(or_, [F.col("joined").contains(word) for word in GATE])
    words = F.split(F.trim("joined"), " ")
    base = F.array().cast("array<struct<word:int,label:string>>")
    for phrase, label in PHRASES:
        hits = _labelled(places(words, phrase), label)
        base = F.concat(base, F.when(F.col("joined").contains(f" {phrase} "), hits).otherwise(F.array().cast("array<struct<word:int,label:string>>")))
    own = F.when(gated, resolved(detections(F.col("joined"), rules_column()))).otherwise(F.array().cast(f"array<{_DETECTION}>"))
    return slim.select(id_column, "n_words", base.alias("base"), own.alias("found"))


def _labelled(hits: Column, label: str) -> Column:
    return F.transform(hits, lambda i: F.struct(i.alias("word"), F.lit(label).alias("label")))


def digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    found = scan(docs, id_column, text_column)
    base_labels, own = F.transform("base", lambda b: b["label"]), F.transform("found", lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    sure = F.greatest(F.when(F.size("base") > 0, 0.7).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda d: d["confidence"])), F.lit(0.0)))
    first = lambda f: f(F.transform("base", lambda b: b["word"])).cast("long")
    return found.select(
        id_column,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        first(F.array_min).alias("first_word"),
        first(F.array_max).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, own)).alias("labels"),
        sure.alias("score"),
    )
