import hashlib
import re

from pyspark.sql import functions as F

from millrace.llm import licenses, pii
from millrace.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_rules_use_known_sentences():
    ids = {n for n, _ in licenses.SENTENCES}
    assert len(ids) == len(licenses.SENTENCES)
    used = {x.replace("\\", "") for _, r in licenses.RULES for x in re.findall(r"<([^<>\[]+)>", r)}
    assert used <= ids, used - ids


def test_recognise(spark):
    rows = [
        (1, "Foo bar.\nThis work is licensed under the GNU General Public License, version 3.\nMore text"),
        (2, "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance\nwith the License. Released under the MIT License."),
        (3, "Nothing here"),
        (4, None),
        (5, "All rights reserved."),
        (6, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted. Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice."),
        (6, "My licence is odd. Copyright (c) 2020 me"),
        (7, "some licence text only"),
        (None, "Released under the MIT License."),
        (8, "x" * 100000 + " license"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("all", F.lit(1))
    got = sorted((r["doc_id"] or 0, r["licenses"]) for r in licenses.recognise(df).collect())
    assert got == [(0, "MIT"), (1, "GPL-3.0"), (2, "Apache-2.0,MIT"), (5, "AllRightsReserved"), (6, ""), (6, "BSD-2-Clause")]
    assert licenses.recognise(df.limit(0)).count() == 0


# One sentence for each identifier.
EXAMPLES = {
    "AGPL3": "GNU Affero General Public License, version 3.", "AGPL": "the GNU Affero General Public License.", "GPL3+": "GNU General Public License version 3, or any later version", "GPL2+": "SPDX-License-Identifier: GPL-2.0-or-later",
    "LGPL3": "GNU Lesser General Public License, Version 3", "LGPL2.1": "under LGPL v2.1", "LGPL": "GNU Library General Public License", "GFDL": "GNU Free Documentation License", "GPL3": "Licensed under the GPLv3", "GPL2": "SPDX-License-Identifier: GPL-2.0", "GPL": "the GNU General Public License",
    "Apache1.1": "Apache Software License, Version 1.1", "Apache2": "License: Apache 2.0", "Apache2Limit": "you may not use this file except in compliance with the License", "Apache2Copy": "You may obtain a copy of the License at", "Apache2AsIs": "software distributed under the License is distributed on an \"AS IS\" BASIS",
    "MITperm": "Permission is hereby granted, free of charge, to any person obtaining a copy", "MITnotice": "The above copyright notice and this permission notice shall be included in all copies", "MITref": "License: MIT", "Zlibuse": "Permission is granted to anyone to use this software for any purpose, including commercial applications",
    "Zliborigin": "The origin of this software must not be misrepresented", "Zlibaltered": "Altered source versions must be plainly marked as such", "Zlibnotice": "This notice may not be removed or altered from any source distribution, license", "Zlibref": "Available under the zlib license",
    "BSDredist": "Redistribution and use in source and binary forms, with or without modification, are permitted", "BSDsource": "Redistributions of source code must retain the above copyright notice", "BSDbinary": "Redistributions in binary form must reproduce the above copyright notice",
    "BSDadvert": "All advertising materials mentioning features or use of this software must display the copyright", "BSDendorse": "may be used to endorse or promote products derived", "BSD3ref": "License: BSD-3-Clause", "BSD2ref": "the Simplified BSD License", "BSDref": "Released under the BSD license",
    "MPL1.1": "Mozilla Public License Version 1.1", "MPL2": "Mozilla Public License, v. 2.0".replace("v. ", "v"), "EPL2": "Eclipse Public License v2.0", "EPL1": "Eclipse Public License version 1.0", "EPL": "the Eclipse Public License", "EUPL": "European Union Public Licence", "CDDL": "Common Development and Distribution License",
    "OSL": "Open Software License", "AFL": "Academic Free License", "MSPL": "Microsoft Public License", "MSRL": "Microsoft Reciprocal License", "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose",
    "Boostperm": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy", "Boostref": "Boost Software License", "Artistic2": "Artistic License 2.0", "Artistic": "the Artistic License", "OFL": "SIL Open Font License", "ODbL": "Open Database License", "ODCBY": "Open Data Commons Attribution License",
    "PDDL": "Public Domain Dedication and License", "PSF": "Python Software Foundation License", "PostgreSQL": "PostgreSQL License", "NCSA": "University of Illinois/NCSA Open Source License", "PHP": "PHP License", "Ruby": "the Ruby license", "WTFPL": "WTFPL", "Unlicense": "This is free and unencumbered software released into the public domain",
    "CC0": "CC0 1.0 Universal", "CCBYNCSA": "CC BY-NC-SA 4.0", "CCBYNCND": "Creative Commons Attribution-NonCommercial-NoDerivs", "CCBYNC": "Licensed under CC BY-NC 4.0", "CCBYSA": "CC-BY-SA", "CCBYND": "CC BY-ND", "CCBY": "Creative Commons Attribution", "CC": "a Creative Commons license", "PublicDomain": "dedicated to the public domain",
    "NonCommercial": "For non-commercial use only", "Proprietary": "Proprietary and confidential", "AsIs": "THIS SOFTWARE IS PROVIDED \"AS IS\"", "NoLiability": "in no event shall the authors be liable", "WarrantyGPL": "WITHOUT ANY WARRANTY, without even the implied warranty",
    "GPLcopy": "You should have received a copy of the GNU license", "AllRights": "All rights reserved", "CopyrightLine": "Copyright (c) 2020 someone",
}


def test_every_sentence_passes_the_gate_however_it_is_broken(spark):
    assert list(EXAMPLES) == [k for k, _ in licenses.SENTENCES]
    rows = [(i, t) for i, t in enumerate(EXAMPLES.values())] + [(1000 + i, t.replace(" ", "\n")) for i, t in enumerate(EXAMPLES.values()) if " " in t]
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (k, t) in enumerate(EXAMPLES.items()):
        assert got.get(i) == k, (k, t, got.get(i))
        if " " in t and ":" not in t:
            assert got.get(1000 + i), (k, t)  # a single line may hold a less precise sentence, which then counts


def test_wrapped_notices_and_sql(spark):
    import duckdb
    import pandas as pd

    rows = [(1, "given to the public\ndomain"), (2, "All rights\nreserved"), (3, "Creative\nCommons Attribution"), (4, "x\nSPDX-License-Identifier: MIT\ny"), (5, "licence of ours"), (6, None), (7, "Licensed under CC\nBY-NC 4.0.")]
    rows += [(100 + i, t) for i, t in enumerate(EXAMPLES.values())]
    got = sorted(tuple(r) for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [x[1] for x in got[:5]] == ["PublicDomain", "AllRightsReserved", "CC-BY", "MIT", "CC-BY-NC"]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    assert sorted(duckdb.sql(licenses.oracle_sql()).fetchall()) == got


def base(text):
    out = []
    luhn = lambda d: sum((x * 2 - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    for i, (p, ok) in enumerate(rules):
        out += [(m.start(), i, m.end()) for m in re.finditer(p, text or "") if ok(m[0])]
    return sorted(out)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


ODD = [None, "", "a@b.c_d@e.f @x.y a@b a@b.c.d.e", "é😀 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "4591718099287256 4591-7180 9928 7256x 4591718099287257", "+1 (652) 555-5229 4 +12 +1-2 +999 999 999 999 999 999",
       "a" * 30000 + " " + "1" * 30000, "1.1.1.1" * 400, "+" + "1 " * 3000, "x@y.z" * 300, "@" * 2000 + "a@b.co", "1-2-" * 4000]


def test_base_spans(spark):
    rows = documents(spark, SF).collect()
    texts = [r["text"] for r in rows] + ODD + ODD[2:4]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("base", F.lit(1))
    for r in pii.scan(df).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in sorted(r["base"], key=lambda s: (s["start"], s["kind"]))] == base(texts[r["doc_id"]])


def test_query(spark):
    rows = {r["doc_id"]: r["text"] for r in documents(spark, SF).collect()}
    got = pii.op7_pii(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(rows[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(written(want).encode()).hexdigest()
        assert set(filter(None, written(want).split(","))) <= set(r["spans"].split(","))
        assert r["n_email"] == sum(k == 0 for _, k, _ in want)


def test_discovery(spark):
    rows = [(i, f"some words Tel: +1 652 555 {1000 + i} and the rest") for i in range(8)]
    rows += [(100, "call Tel: 652-555-9999 now"), (101, "number 652-555-8888 of many"), (102, "number nothing"), (103, None), (None, "call Tel: 652-555-9999 now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    more = {r["doc_id"]: [s["value"] for s in r["more"]] for r in pii.find(df).collect() if r["more"]}
    assert more == {100: ["652-555-9999"], None: ["652-555-9999"]}
    assert pii.find(df.limit(0)).count() == 0


def test_discovery_beside_labels_and_to_the_end(spark):
    rows = [(i, f"some words tel:+49 301 234 {1000 + i} and tel:+49 301 235 {1000 + i} on") for i in range(6)]
    rows += [(20, "call tel:0301234567 now"), (21, "tel:none of these")]
    rows += [(30 + i, f"ip 10.0.0.{i} on") for i in range(8)] + [(40, "ip 10[.]0[.]7[.]9 on")]
    # Each word is learned from the numbers that the word before it has made known.
    names = "abcdefg"
    rows += [(100 + i, f"wa +1 555 010 20{i:02}") for i in range(12)]
    for k in range(6):
        for i in range(6):
            number = f"652-5{k}5-10{i:02}"
            rows += [(1000 + 100 * k + i, f"w{names[k]} {number}"), (2000 + 100 * k + i, f"w{names[k + 1]} {number}"), (3000 + 100 * k + i, f"w{names[k + 1]} {number}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    more = {r["doc_id"]: [s["value"] for s in r["more"]] for r in pii.find(df).collect() if r["more"]}
    assert more[20] == ["0301234567"] and more[40] == ["10[.]0[.]7[.]9"] and 21 not in more
    assert more[1505] == more[2505] == ["652-555-1005"]


def test_many_matches_of_one_text_and_long_words(spark, monkeypatch):
    label = "q" * 200 + "tel:"
    many = " ".join(f"a{i}@b.co {label}+49 301 234 {1000 + i}" for i in range(40))
    rows = [(1, many), (2, f"x {label}0301234567 y"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = lambda: sorted((r["doc_id"], [tuple(s) for s in r["base"]], sorted(tuple(s) for s in r["loose"])) for r in pii.scan(df).collect())
    whole = spans()
    monkeypatch.setattr(pii, "FOLD", 7)
    assert spans() == whole
    assert [(s[0], s[2], s[1]) for s in whole[0][1]] == base(many)
    more = {r["doc_id"]: [s["value"] for s in r["more"]] for r in pii.find(df).collect() if r["more"]}
    assert more == {2: ["0301234567"]}


def test_bootstrap_against_brute_force(spark):
    """The patterns and values that plain loops over the spans find, round by round."""
    import random

    r = random.Random(3)
    labels = ["tel:", "fax", "no.", "call", "id"]
    rows = []
    for i in range(120):
        word = r.choice(labels)
        number = r.choice([f"+49 301 23{r.randint(1000, 1040)}", f"0301 23{r.randint(1000, 1040)}", f"{r.randint(10**9, 10**9 + 30)}", "none"])
        rows.append((i, f"some {word} {number} and other {r.choice(labels)} words"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = [x.asDict() for x in pii.scan(df).collect()]
    base_of = [(s["kind"], s["value"], s["word"]) for x in spans for s in x["base"] if s["word"]]
    loose_of = [(s["kind"], s["value"], s["word"]) for x in spans for s in x["loose"] if s["word"]]
    tokens = [t for _, text in rows for t in text.lower().split()]
    known = set()
    while True:
        hits = base_of + [x for x in loose_of if x[:2] in known]
        score = {}
        for kind, word in {(k, w) for k, _, w in loose_of}:
            own = [v for k, v, w in hits if (k, w) == (kind, word)]
            least = sum((k, w) == (kind, word) for k, _, w in base_of + loose_of)
            p = min(len(own) / max(least, tokens.count(word)), 0.999)
            if len(set(own)) >= pii.SUPPORT and p >= pii.CONFIDENCE:
                for v in {v for k, v, w in loose_of if (k, w) == (kind, word)}:
                    score[kind, v] = 1 - (1 - score.get((kind, v), 0)) * (1 - p)
        more = known | {x for x, s in score.items() if s >= pii.CONFIDENCE}
        if more == known:
            break
        known = more
    from millrace.llm.common import materialize

    got = {tuple(x) for x in pii.bootstrap(materialize(pii.scan(df), "spans"), df, confidence=pii.CONFIDENCE).collect()}
    assert got == known


def test_several_licences_in_a_sentence(spark):
    """Rows by hand; the SQL is not asked."""
    want = {
        "This project is licensed under the MIT license or the Apache License, Version 2.0": {"MIT", "Apache-2.0"},
        "SPDX-License-Identifier: MIT OR Apache-2.0": {"MIT", "Apache-2.0"},
        "// SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause": {"Apache-2.0", "MIT", "BSD-3-Clause"},
        "SPDX-License-Identifier: MIT": {"MIT"},
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. It is licensed under the MIT License': {"MIT"},
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["doc_id"]: set(r["licenses"].split(",")) for r in licenses.recognise(df).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions in the documentation."""


def test_wrapped_notices_beside_lines(spark):
    """Rows by hand; the SQL must read them alike."""
    import duckdb
    import pandas as pd

    lines = "Released under the MIT License\nSPDX-License-Identifier: ISC\nApache License, Version 2.0\n"
    want = [
        (GPL, {"GPL-3.0-or-later"}),
        ("\n".join(f" * {x}" for x in GPL.split("\n")), {"GPL-3.0-or-later"}),
        (GPL.replace("version 3", "version 2").replace("; either", ";\neither"), {"GPL-2.0-or-later"}),
        (lines + "\n" + BSD, {"MIT", "Apache-2.0", "BSD-2-Clause", "ISC"}),
        (lines + BSD, {"MIT", "Apache-2.0", "BSD-2-Clause", "ISC"}),
        (BSD + "\n" + GPL + "\n" + lines, {"BSD-2-Clause", "GPL-3.0-or-later", "MIT", "Apache-2.0", "ISC"}),
        ("Dual licensed.\nReleased under the MIT License\nor the Apache License, Version 2.0", {"MIT", "Apache-2.0"}),
        ("It is given to the\npublic domain\n\nLicensed under the\nGPLv3", {"PublicDomain", "GPL-3.0"}),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(want)] + [(90, None), (91, ""), (92, "\x01\n\n;\n"), (93, "licence\n" * 3000), (94, BSD), (94, BSD)]
    found = licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: set(r["licenses"].split(",")) for r in found}
    names = set().union(*(w for _, w in want))
    assert [got[i] & names | {x for x in got[i] if x.startswith(("GPL", "BSD"))} for i in range(len(want))] == [w for _, w in want]
    assert set(got) == {*range(len(want)), 94} and len(found) == len(want) + 2
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    assert sorted(duckdb.sql(licenses.oracle_sql()).fetchall()) == sorted(map(tuple, found))
