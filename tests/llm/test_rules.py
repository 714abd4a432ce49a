import re
from collections import Counter

import numpy as np
import pytest

from collonade.llm import licences, outliers
from collonade.llm.common import prefix_sums


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_base_statistics(odd, nothing):
    got = outliers.digests(outliers.judge(odd)).collect()
    assert sorted((r.doc_id or -1, *r[1:7]) for r in got) == sorted((r.doc_id or -1, *base(r.text)) for r in odd.collect())
    assert all(not r.kept for r in got if r.base_failed)
    assert outliers.judge(nothing).count() == 0


def test_estimates_against_brute_force(spark):
    rng = np.random.default_rng(1)
    clean, junk = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)), rng.normal(8, 1, size=(90, 5))
    names = [*outliers.FLOORS]
    x = np.vstack([clean, junk])
    df = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(x)], "scope string, id int, " + ", ".join(f"{n} double" for n in names))
    fitted = outliers.fit(df, names)
    d2 = np.array([r.d2 for r in sorted(outliers.distances(df, fitted, names).select("id", "d2").collect())])
    # Brute force: concentration steps in full precision from each start, with the same floors; the least determinant stays.
    floor = np.diag(np.array([*outliers.FLOORS.values()]) ** 2)
    far = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + floor), x - m)
    middle, spread = np.median(x, 0), np.maximum(np.subtract(*np.percentile(x, [75, 25], 0)) / 1.349, np.sqrt(np.diag(floor)))
    squashed = np.cov(np.tanh((x - middle) / spread).T, bias=True) * np.outer(spread, spread)
    ends = []
    for mean, cov in [(middle, np.diag(spread**2)), (middle, squashed), (x.mean(0), np.cov(x.T, bias=True))]:
        for _ in range(100):
            near = x[np.argsort(far(mean, cov))[: int(0.75 * len(x))]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True)
        ends.append((np.linalg.slogdet(cov + floor)[1], mean, cov))
    least, mean, cov = min(ends, key=lambda e: e[0])
    want = far(mean, outliers.CONSISTENT * cov)
    assert np.corrcoef(np.log(d2), np.log(want))[0, 1] > 0.99
    assert ((d2 > outliers.CUTOFF) == (want > outliers.CUTOFF)).mean() > 0.995 and (d2[400:] > outliers.CUTOFF).all()


def test_groups_are_counted_by_sound_rows(spark):
    """A source whose rows are mostly too short to be fitted to shares another fit and is judged by it."""
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, text(rng.integers(20, 200)), "en", f"s{i % 20}") for i in range(200)]
    rows += [(1000 + i, "short", "en", "few") for i in range(100)] + [(2000, text(50) + " ##$$%%" * 200, "en", "few"), (2001, text(60), "en", "few")]
    got = {r.doc_id: r.kept for r in outliers.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not got[2000] and got[2001] and sum(got[i] for i in range(200)) >= 195


def test_outliers_go_and_others_stay(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{data.replace('0.001', '0.01')}/labels.parquet")
    got = outliers.judge(docs).join(labels, "doc_id").groupBy("quality").agg({"kept": "count"})
    assert got.count() == 2
    rows = outliers.judge(docs).join(labels, "doc_id").selectExpr("quality", "cast(kept as int) kept").groupBy("quality").avg("kept").collect()
    share = {r[0]: r[1] for r in rows}
    assert share[0] < 0.1 and share[1] > 0.94


def test_prefix_sums(spark):
    import random

    from pyspark.sql import functions as F

    rows = [[random.Random(n).randrange(9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<bigint>")
    for r in df.select("i", "v", prefix_sums(F.col("v")).alias("p")).collect():
        assert r.p == [sum(r.v[:k]) for k in range(len(r.v))]


WRAPPED_ISC = "Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that the above\n# copyright notice and this permission notice appear in all copies."
WRAPPED_MIT = "Permission is hereby granted, free\nof charge, to any person obtaining\na copy of this software and\nassociated documentation files"
LICENCES = [
    ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("All rights reserved.", "reserved"), ("the driver lost his license in the storm", "unknown"),
    ("Distributed under MIT", "mit"), ("Released under GPLv3.", "gpl"), ("Available under LGPLv2.1 or later", "lgpl"), ("# SPDX-License-Identifier: Apache-2.0", "apache"), ("// SPDX-License-Identifier: GPL-2.0-or-later", "gpl"), ("SPDX-License-Identifier: EPL-2.0", "epl"), ("WTFPL", "wtfpl"), (WRAPPED_ISC, "isc"), (WRAPPED_MIT, "mit"),
    ("Distributed under the Boost Software\nLicense, Version 1.0.", "boost"), ("under the terms of the GNU Affero General\nPublic License", "agpl"), ("Text is available under the Creative Commons Attribution-ShareAlike License", "cc-by-sa"), ("a CC0-1.0 work", "public-domain"), ("use is governed by a BSD-style licence", "bsd"), ("MPL-2.0", "mpl"), ("RELEASED UNDER THE MIT LICENSE", "mit"), ("SPDX-License-Identifier: MIT OR GPL-2.0-only", None), ("mit-licensed code", "mit"),
    ("licensed under the Foo Public Licence", "unknown"), ("© 2019 Jane Doe", "unknown"), ("He works at MIT and likes it.", "unknown"), ("The software has no licence.", "unknown"), ("lorem ipsum " * 5000 + "\nReleased under the MIT License.\n" + "dolor sit " * 5000, "mit"),
]


def test_licences(spark, odd, nothing):
    df = spark.createDataFrame([(i, "first line\n" + t) for i, (t, _) in enumerate(LICENCES)], "doc_id bigint, text string")
    df = df.union(spark.createDataFrame([(50, "wir fahren mit dem zug nach hause"), (51, None), (52, "DER!! MIT,!! NICHT!! EIN"), (53, "MIT!! DER TUER")], df.schema))
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert len(got) == len(LICENCES)
    assert [got[i].family for i, (_, f) in enumerate(LICENCES) if f] == [f for _, f in LICENCES if f]
    assert all(got[i].confirmed == (f != "unknown") for i, (_, f) in enumerate(LICENCES) if f)
    assert all(got[i].line == (1 if "lorem" not in t else 2) for i, (t, _) in enumerate(LICENCES))
    assert licences.scan(odd).count() == 0 and licences.scan(nothing).count() == 0


def test_licences_in_odd_rows(spark):
    """Paragraphs end at empty lines; nulls, ties, repeated rows and clashing names change no verdict."""
    notice = "Released under\nthe MIT License."
    text = "intro\n\n" + notice + "\n \t\n\nplain words\r\n\r\nAvailable under LGPLv2.1\n"
    rows = [(1, text, "x", 1), (1, text, None, 2), (None, text, "y", None), (2, "", "", 0), (3, None, "", 0)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string, family string, line int")).collect()
    want = [(3, notice, "mit", True), (8, "Available under LGPLv2.1", "lgpl", True)]
    assert sorted((r.doc_id or 0, r.line, r.paragraph, r.family, r.confirmed) for r in got) == sorted((i, *w) for i in (0, 1, 1) for w in want)


def test_lines_with_licences_are_all_found(spark, data):
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    phrases = {"GNU General Public License, version 3": "gpl", "MIT License": "mit", "CC BY-NC 4.0": "cc-by-nc", "Apache License, Version 2.0": "apache"}
    want = sorted((r.doc_id, f) for r in docs.collect() for p, f in phrases.items() if p in (r.text or ""))
    assert want and sorted((r.doc_id, r.family) for r in licences.scan(docs).collect() if r.family in phrases.values()) == want


@pytest.mark.parametrize("words", [["a", "license", "b"], []])
def test_grams_stay_near_licence_words(spark, words):
    far = ["w"] * 10
    df = spark.createDataFrame([(" ".join(far + words + far),)], "paragraph string")
    got = licences.with_grams(df).first().grams
    assert all(len(g.split()) <= 3 for g in got) and (not words or "a license b" in got) and (words or got == [])


def test_licences_that_are_others_or_none(spark):
    """Names within longer names, words that speak of something else, denials, and several families in a paragraph."""
    cases = [
        ("Licensed under CC BY-ND 4.0", "cc-by-nd", ["cc-by-nd"]), ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd", ["cc-by-nc-nd"]),
        ("Text under CC BY-NC-SA 4.0.", "cc-by-nc", ["cc-by-nc"]), ("released under the LGPL version 3", "lgpl", ["lgpl"]),
        ("He bought a fishing license in the public domain of the lake", "unknown", []), ("All rights reserved for the king in the castle", "unknown", []),
        ("Not licensed under the MIT license", "unknown", []), ("This code is no longer distributed under the terms of the GNU General Public License.", "unknown", []),
        ("SPDX-License-Identifier: MIT OR GPL-2.0-only", "mit", ["mit", "gpl"]), ("You may choose the Apache License, Version 2.0 or the BSD 3-Clause License.", None, ["apache", "bsd"]),
        ("The lake is not far. Released under the ISC license.", "isc", ["isc"]), ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd", ["bsd"]),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id int, text string")).collect()}
    for i, (text, family, families) in enumerate(cases):
        assert (family is None or got[i].family == family) and sorted(got[i].families) == sorted(families), (text, got[i])
        assert got[i].confirmed == bool(families), text
