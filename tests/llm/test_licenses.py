"""Licences whose notices differ by a word or two."""

from pitlane.llm import licenses

NOTICE = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public "
          "License as published by the Free Software Foundation")


def test_the_fullest_match_names_the_licence(spark):
    work = "This work is licensed under the GNU General Public License, version {}."
    rows = [(1, NOTICE.format("")), (2, NOTICE.format("Lesser ")), (3, NOTICE.format("Affero ")), (4, work.format(2)),
            (5, work.format(3)), (6, NOTICE.format("Affero ") + " and more words here. " + work.format(2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    assert got == {1: "GPL", 2: "LGPL", 3: "AGPL", 4: "GPL-2.0", 5: "GPL-3.0", 6: "AGPL,GPL-2.0"}


def test_short_lines_and_identifiers(spark):
    rows = [(1, "Licensed under CC BY 4.0."), (2, "Licensed under CC BY-SA 4.0."), (3, "Licensed under CC BY-NC 4.0."),
            (4, "# SPDX-License-Identifier: GPL-3.0-or-later\ncode"), (5, "// SPDX-License-Identifier: LGPL-2.1-only"),
            (6, "SPDX-License-Identifier: BSD-3-Clause"), (7, "SPDX-License-Identifier: Apache-2.0"),
            (8, "SPDX-License-Identifier: CC-BY-SA-4.0"), (9, "SPDX-License-Identifier: GPL-2.0"), (10, "licensed under cc"),
            (11, ""), (12, None), (7, "SPDX-License-Identifier: Apache-2.0"), (13, "SPDX-License-Identifier: AGPL-3.0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["licenses"]) for r in licenses.scan(docs).collect())
    assert got == [(1, "CC-BY-4.0"), (2, "CC-BY-SA-4.0"), (3, "CC-BY-NC-4.0"), (4, "GPL-3.0"), (5, "LGPL"), (6, "BSD"),
                   (7, "Apache-2.0"), (7, "Apache-2.0"), (8, "CC-BY-SA-4.0"), (9, "GPL-2.0"), (10, ""), (11, ""), (12, ""),
                   (13, "AGPL")]


def test_ties_all_stay_and_long_texts_are_whole(spark):
    same = (("one", "alpha beta gamma delta epsilon zeta"), ("two", "alpha beta gamma delta epsilon zeta"))
    docs = spark.createDataFrame([(1, "word " * 200_000 + same[0][1])], "doc_id long, text string")
    got = licenses.scan(docs, same).first()
    assert got["licenses"] == "one,two" and got["spans"] == "one:200000:200006,two:200000:200006"
