from docloom.llm.licenses import KNOWN, known_licenses, scan_licenses

DOC = "doc_id long, text string, digest string, license string, lines string"


def test_entire_texts_and_lines(spark, make):
    mit = next(t for k, t in KNOWN if k == "MIT")
    rows = [(1, "MIT Licence\n\nCopyright (c) 2020 Some One. All rights reserved.\n\n" + mit.upper().replace(",", " ; ")),
            (2, "text\nLICENSED under the Apache Licence - Version 2.0!\nmore\nAll rights reserved."), (3, "Released under the MIT License"),
            (4, None), (5, ""), (6, mit + " and more"), (None, "All rights reserved."), (3, "Released under the MIT License"),
            (7, "word " * 200_000 + "\nSPDX-License-Identifier: MIT"), (8, "© 2020 x\n(c) y\nCopyright 2020 z")]
    docs = make([(*r, "d", "l", "x") for r in rows], DOC)
    got = scan_licenses(docs, known_licenses(spark)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.license, r.line_licenses) for r in got}
    assert by[1] == ("MIT", []) and by[2] == (None, ["Apache-2.0", "LicenseRef-all-rights-reserved"])
    assert by[3] == ("MIT", ["MIT"]) and by[6][0] is None and by[7] == (None, ["MIT"])
    assert by[None] == ("LicenseRef-all-rights-reserved", ["LicenseRef-all-rights-reserved"])
    assert by[4] == by[5] == by[8] == (None, []) and len({r.digest for r in got if r.doc_id in (4, 5, 8)}) == 1
    assert scan_licenses(make([], DOC), known_licenses(spark)).count() == 0
    assert {r.license for r in scan_licenses(docs, known_licenses(spark).where("false")).collect()} == {None}


def test_whole_texts_and_spdx_lines_of_the_usual_licenses(spark, make):
    texts = {k: next(t for x, t in KNOWN if x == k) for k in (
        "MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only",
        "MPL-2.0", "CC0-1.0", "Unlicense")}
    assert all(len(t) > 600 for t in texts.values())
    bsd = texts["BSD-2-Clause"].replace("1. ", "   * ").replace("2. ", "   * ").replace('"AS IS"', "``AS IS''").replace(", ", ",\n")
    spdx = ["ISC", "MPL-2.0", "GPL-3.0-or-later", "GPL-2.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-only", "Unlicense", "Zlib", "CC-BY-4.0"]
    rows = [*texts.items(), ("BSD-2-Clause", "Copyright 2019 The Authors.\n\n" + bsd),
            ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A B\nAll rights reserved.\n\n" + texts["BSD-3-Clause"]),
            ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 A B\n\n" + texts["MIT"]),
            ("Apache-2.0", texts["Apache-2.0"].split("   APPENDIX")[0]), ("GPL-3.0-only", texts["GPL-3.0-only"].replace("http:", "https:"))]
    docs = make([(i, t, "d", "l", "x") for i, (_, t) in enumerate(rows)]
                + [(100 + i, f"#!/bin/sh\n# SPDX-License-Identifier: {k}\ntrue", "d", "l", "x") for i, k in enumerate(spdx)], DOC)
    got = {r.doc_id: r for r in scan_licenses(docs, known_licenses(spark)).collect()}
    assert [got[i].license for i in range(len(rows))] == [k for k, _ in rows]
    assert [got[100 + i].line_licenses for i in range(len(spdx))] == [[k] for k in spdx]


def test_native(spark, make):
    docs = make([(1, "a", "d", "l", "x")], DOC)
    plan = scan_licenses(docs, known_licenses(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))
