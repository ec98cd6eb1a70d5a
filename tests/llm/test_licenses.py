import random
import re
from re import _parser

from hearthline.llm import licenses as L

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def expected(text):
    words = re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text))
    base = [(i, label) for phrase, label in L.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    joined = f" {' '.join(words)} "
    found = []
    for k, (label, keyword, regex, priority, confidence) in enumerate(L.RULES):
        if keyword in joined:
            found += [(k, label, m.start(), m.end(), priority, confidence) for m in re.finditer(f"(?<= )(?:{regex})(?= )" if "|" in regex.split("(?:")[0] else f"(?<= ){regex}(?= )", joined)]
    def beaten(d, e):
        same = e[2:4] == d[2:4]
        return e[2] <= d[2] and e[3] >= d[3] and (e[4] < d[4] or e[4] == d[4] and (not same or e[0] < d[0]))
    kept = [d for d in found if not any(beaten(d, e) for e in found)]
    places = [i for i, _ in base]
    labels = {label for _, label in base}
    return (len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {d[1] for d in kept})), max([0.7 if base else 0.0, *(d[5] for d in kept)]))


def test_against_brute_force(spark, docs_of):
    rng = random.Random(1)
    parts = ["GNU General Public License", "gnu  general-public\nlicense, version 3", "Apache License, Version 2.0.", "CC BY-NC 4.0", "cc by", "MIT License.", "Released under the", "licensed under the", "SPDX-License-Identifier: Apache License 2.0", "All rights reserved.", "Copyright (c) 2021", "word", "MIT LİCENSE M\u212a", "ÉCOLE école", "né", "日本", "GNU Lesser General Public License v2.1", "public domain", "is in the public domain", "…", "éMIT license", "permission is hereby granted, free of charge, to any person obtaining a copy"]
    texts = [None, "", " \n", "--", "mit", "license " * 20_000, "mit license " * 500]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(250)]
    rows = sorted(L.digest(docs_of(texts)).collect())
    assert [tuple(r)[1:] for r in rows] == [expected(t or "") for t in texts]
    assert len({r.labels for r in rows}) > 20


def test_rules(docs_of):
    assert len(L.RULES) >= 200
    for label, keyword, regex, priority, confidence in L.RULES:
        re.compile(regex)
        assert 0 <= confidence <= 1 and priority >= 0 and label and keyword
    assert L.digest(docs_of([])).count() == 0
    plan = L.digest(docs_of(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_priority_and_containment(docs_of):
    row = L.digest(docs_of(["Licensed under the Apache License, Version 2.0."])).collect()[0]
    assert row.labels == "apache,apache-2.0" and row.score == 0.95
    row = L.digest(docs_of(["Licensed under CC BY-NC 4.0."])).collect()[0]
    assert row.labels == "cc-by,cc-by-nc-4.0"


def examples(parsed):
    """Texts that match, with each alternative, option and member of a set of the regex in one of them at least."""
    options = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            options.append([chr(arg)])
        elif name == "IN":
            options.append([chr(a if str(o) == "LITERAL" else a[0]) for o, a in arg])
        elif name == "BRANCH":
            options.append([e for branch in arg[1] for e in examples(branch)])
        elif name == "SUBPATTERN":
            options.append(examples(arg[-1]))
        else:
            assert name == "MAX_REPEAT", name
            options.append([e * max(1, arg[0]) for e in examples(arg[2])] + [""] * (arg[0] == 0))
    first = [o[0] for o in options]
    return ["".join(first), *("".join([*first[:i], o, *first[i + 1 :]]) for i, each in enumerate(options) for o in each[1:])]


def test_every_match_passes_keyword_and_gate():
    for label, keyword, regex, _, _ in L.RULES:
        for text in examples(_parser.parse(regex)):
            assert re.fullmatch(regex, text)
            if keyword == "spdx license identifier" and "identifier" not in regex:
                text = f"{keyword} {text}"  # an expression's further identifiers count behind a statement only
            assert keyword in f" {text} ", (label, keyword, text)
            assert any(word in f" {text} " for word in L.GATE), (label, text)


def test_notices_behind_a_keyword(docs_of):
    texts = ["Unauthorized copying of this file, via any medium is strictly prohibited", "CreativeML Open RAIL-M", "BigScience OpenRAIL-M license"]
    assert [r.labels for r in sorted(L.digest(docs_of(texts)).collect())] == ["proprietary", "openrail", "openrail"]


def test_spdx_identifiers_and_short_forms(docs_of):
    spdx = {
        "MIT": "mit", "Apache-2.0": "apache-2.0", "GPL-2.0-only": "gpl-2.0", "GPL-2.0+": "gpl-2.0", "GPL-3.0-or-later": "gpl-3.0", "LGPL-2.1-or-later": "lgpl-2.1", "MPL-2.0": "mpl-2.0", "ISC": "isc", "MIT-0": "mit-0",
        "AGPL-3.0-only": "agpl-3.0", "EPL-2.0": "epl-2.0", "Zlib": "zlib", "BSD-3-Clause": "bsd-3-clause", "(MIT OR Apache-2.0)": "apache-2.0,mit", "GPL-2.0-only WITH Linux-syscall-note": "gpl-2.0",
        "GPL-2.0-or-later WITH Classpath-exception-2.0 OR MIT OR ISC": "gpl-2.0,isc,mit",
    }
    short = {"GPLv3": "gpl-3.0", "under GPL v2 or later": "gpl-2.0", "LGPLv2.1": "lgpl-2.1", "Apache 2.0": "apache-2.0", "AGPL-3.0": "agpl-3.0", "MPL 2.0": "mpl-2.0", "MIT licensed": "mit", "simple example of apaches": "", "MIT": ""}
    texts = [f"// SPDX-License-Identifier: {name}" for name in spdx] + [*short, "Licensed under MIT."]
    rows = sorted(L.digest(docs_of(texts)).collect())
    assert [r.labels for r in rows] == [*spdx.values(), *short.values(), "mit"]
    assert {r.score for r in rows[: len(spdx)]} == {1.0} and rows[-1].score == 0.95
