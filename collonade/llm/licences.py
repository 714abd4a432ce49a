"""License scans by a trained paragraph classifier.

A paragraph ends at an empty line; its lines are read as one, so notices wrapped
at any width stay whole.  Its sparse n-grams of one to three words that hold a
licence word are the features; a multinomial logistic regression, trained here on
phrases (leads before names) and notices, gives a family or "unknown".  The
probability from which a family is believed is calibrated on leads, notices,
unknown names and ordinary paragraphs that the calibrated fit has not seen; the
model used is then fitted on all of them.  A prediction counts as confirmed if a
name of its family stands in the paragraph, or enough word pairs of a notice.

All of it is SQL and ML functions of DataFrames.  A paragraph without a licence
word has no features and is unknown by the intercept alone: it gets no row.  Every
word of a paragraph is read, whatever its length.  Defined results: null and empty
texts have no rows; repeated rows give repeated results; other columns of the input
are not read and may have any name; an empty table gives none.  Of equal
probabilities the family first in FAMILIES wins.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collonade.llm.common import prefix_sums

# Names of licences by family, as words_of gives them ("mitlicense" is MIT in capitals or before "license").
NAMES = {
    "mit": ["mitlicense", "mitlicense license", "mitlicense style license", "expat license"],
    "apache": ["apache license version 2 0", "apache license", "apache 2 0", "apache software license", "apache version 2"],
    "gpl": ["gnu general public license", "gnu general public license version 2", "gnu general public license version 3", "gnu gpl", "gpl", "gpl 2 0 or later", "gpl 3 0 only", "gpl version 2", "gpl version 3"],
    "lgpl": ["gnu lesser general public license", "gnu lesser general public license version 2 1", "gnu library general public license", "gnu lgpl", "lgpl", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl version 3"],
    "agpl": ["gnu affero general public license", "gnu affero general public license version 3", "affero gpl", "agpl", "agpl 3 0 or later", "agpl version 3"],
    "bsd": ["bsd license", "bsd style license", "bsd 2 clause license", "bsd 3 clause", "3 clause bsd license", "2 clause bsd license", "simplified bsd license", "new bsd license", "bsd"],
    "isc": ["isc license", "isc"],
    "mpl": ["mozilla public license", "mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0", "mpl"],
    "epl": ["eclipse public license", "eclipse public license version 2 0", "eclipse public license 1 0", "epl 2 0", "epl"],
    "boost": ["boost software license", "boost software license version 1 0", "bsl 1 0", "boost license"],
    "zlib": ["zlib license", "zlib libpng license", "zlib"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public license", "wtfpl version 2"],
    "cc-by": ["cc by 4 0", "cc by", "cc by 3 0", "creative commons attribution 4 0 international license", "creative commons attribution license", "creativecommons org licenses by 4 0"],
    "cc-by-sa": ["cc by sa 4 0", "cc by sa", "cc by sa 3 0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike license", "creativecommons org licenses by sa 4 0"],
    "cc-by-nd": ["cc by nd 4 0", "cc by nd", "cc by nd 3 0", "creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives license", "creativecommons org licenses by nd 4 0"],
    "cc-by-nc-nd": ["cc by nc nd 4 0", "cc by nc nd", "cc by nc nd 3 0", "creative commons attribution noncommercial noderivatives 4 0 international license", "creative commons attribution noncommercial noderivatives license", "creativecommons org licenses by nc nd 4 0"],
    "cc-by-nc": ["cc by nc 4 0", "cc by nc", "cc by nc sa", "cc by nc sa 4 0", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial license", "creativecommons org licenses by nc 4 0"],
    "public-domain": ["public domain", "cc0", "cc0 1 0 universal", "cc0 1 0", "unlicense", "creative commons zero"],
    "reserved": ["all rights reserved"],
}
# Notices by family, in lower case without marks.
NOTICES = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "apache": ["you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "licensed to the apache software foundation asf under one or more contributor license agreements"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"],
    "boost": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "zlib": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document do what the fuck you want to"],
    "public-domain": ["this is free and unencumbered software released into the public domain", "this work has been dedicated to the public domain", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights"],
    "reserved": ["copyright by the author all rights reserved no part may be reproduced without permission", "no part of this publication may be reproduced or transmitted without the prior permission of the publisher"],
}
# Phrases before a name; those of HELD_LEADS are kept for the calibration.
LEADS = ["", "licensed under", "licensed under the", "this work is licensed under the", "released under the", "distributed under the", "under the terms of the", "spdx license identifier", "available under", "this project is under the", "license", "governed by the", "dedicated to the"]
HELD_LEADS = ["published under the", "it is provided under", "you may use this code under the terms of the", "the license is"]
# Names of nothing that is a family; the second half is kept for the calibration.
OTHERS = ["house rules", "terms of service", "end user license agreement", "company license", "commercial license", "license agreement", "general public", "software agreement", "same conditions", "city license", "evaluation license version 2 0", "permission of the mayor", "old software contract", "public school rules", "fishing license", "license of the vendor"]
# Paragraphs with licence words that state no licence; every fourth is kept for the calibration.
ORDINARY = ["the driver lost his license after the accident", "she studied at mitlicense for a year", "a professor at mitlicense wrote about it", "the apache tribe lived in the region", "apache helicopters flew over the town", "human rights are discussed in the second chapter", "a permission was needed to enter the building", "the public was invited to the free concert", "copyright law is a difficult subject", "copyright 2020 the authors", "the city council voted to license new taxis", "creative writing is taught at the school", "the commons is a park near the river", "they reserved a table for four", "all rights and duties are listed in the contract", "version 3 of the plan was released in may", "public opinion and the domain of politics", "the license plate was stolen", "your rights as a tenant", "the general public may use the library", "he redistributed the seats among the groups", "under the terms of the agreement both sides withdrew", "free software is popular", "a boost for the economy", "the eclipse was seen by the public", "an attribution of the painting to the master", "the software has no warranty", "permission is granted to enter the park", "wildebeest such as the gnu graze there", "commercial software was sold in boxes", "the domain name was registered", "the car was sold without a license", "send a cc to the director", "the zlib of the machine was broken", "mozilla opened an office in the city", "a fishing license in the public domain of the valley", "all rights reserved for the queen in the castle", "in the public domain of the town all may walk", "it was not licensed under the mitlicense license", "the code is not released under the apache license", "this is no longer distributed under the gpl"]
# The words without which no n-gram is a feature.
ANCHORS = "license licensed licenses licensing unlicense sublicense copyright gpl lgpl agpl gnu affero lesser apache bsd bsl boost isc mpl epl wtfpl zlib expat mozilla eclipse mitlicense spdx creative creativecommons commons attribution sharealike noncommercial noderivatives cc cc0 rights reserved redistribute redistribution redistributions permission permitted granted domain software unencumbered reproduced dedicated".split()
FAMILIES = [*NAMES]
UNKNOWN = "unknown"
LEAST_CONTAINED, PRECISION = 0.6, 0.99
#: What stands between two paragraphs; the cut leaves every character in place.
BETWEEN = r"(?<=\n)(?=[\x20\t\r]*\n)"
#: MIT in capitals, but not in a text that is all in capitals, where it may be the German word.
MIT = (
    r"(?-i:(?=MIT)(?:(?<!\p{Lu}[^\p{L}\p{N}]{1,8})|(?<=(?:OR|AND|GPL|BSD|ISC|LICENSE|LICENCE)[^\p{L}\p{N}]{1,8}))MIT(?![\p{L}\p{N}])"
    r"(?![^\p{L}\p{N}]{1,8}(?!(?:OR|AND|WITH|[AL]?GPL|BSD|ISC)(?![\p{L}\p{N}]))\p{Lu}{2}))|(?i:mit)(?=[-\x20/](?i:licen))"
)
#: Matches wherever words_of can give an anchor: they themselves, other spellings, and names with a version tied to them.
ANCHOR = (
    r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(a for a in ANCHORS if a not in ("mitlicense", "sharealike", "noncommercial", "noderivatives"))
    + r"|(?:un|sub)?licen[cs](?:e|ed|es|ing)|" + MIT + r"|share[-\s]?alike|non[-\s]?commercial|no[-\s]?deriv(?:ative)?s)(?:v?[0-9][0-9.]*\+?)?(?![\p{L}\p{N}])|©|\(c\)"
)


def words_of(paragraph: Column) -> Column:
    """Words in lower case; MIT is a word of its own where it is no German "mit", and versions are words of their own."""
    for pattern, to in [
        (r"(?<![\p{L}\p{N}])(?:" + MIT + r")(?![\p{L}\p{N}])", "mitlicense"),
        (r"©|(?i)\(c\)", " copyright "),
        (r"(?i)(?<![\p{L}\p{N}])([al]?gpl|apache|mpl|epl|bsd|wtfpl|bsl)v?(?=[0-9])", "$1 version "),
        (r"(?i)(?<![\p{L}\p{N}])v\.?(?=[0-9])", "version "),
        (r"(?i)licenc(?=e|ing)", "licens"),
        (r"(?i)share[-\s]alike", "sharealike"),
        (r"(?i)non[-\s]commercial", "noncommercial"),
        (r"(?i)(?<![\p{L}\p{N}])no[-\s]?deriv(?:ative)?s(?![\p{L}\p{N}])", "noderivatives"),
    ]:
        paragraph = F.regexp_replace(paragraph, pattern, to)
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_grams(df: DataFrame) -> DataFrame:
    """Add words of the paragraph, and grams: each one to three in a row that hold a licence word, once."""
    anchors = F.array(*[F.lit(a) for a in ANCHORS])
    df = df.withColumn("words", words_of(F.col("paragraph")))
    df = df.withColumn("_at", F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(anchors, w), i)), lambda i: i.isNotNull()))
    starts = F.array(*[F.struct(F.lit(-back).alias("back"), F.lit(n).alias("n")) for n in (1, 2, 3) for back in range(n)])
    inside = lambda s, i: (i + s["back"] >= 0) & (i + s["back"] + s["n"] <= F.size("words"))
    gram = lambda i: F.transform(F.filter(starts, lambda s: inside(s, i)), lambda s: F.array_join(F.slice("words", i + s["back"] + 1, s["n"]), " "))
    return df.withColumn("grams", F.array_distinct(F.flatten(F.transform("_at", gram)))).drop("_at")


def training(spark: SparkSession) -> DataFrame:
    """(paragraph, label, held): leads before names, whole and cut notices, other names and ordinary paragraphs, each alone and among others."""
    rows = []
    labels = {f: float(i) for i, f in enumerate([*FAMILIES, UNKNOWN])}
    for family in FAMILIES:
        label = labels[family]
        rows += [(f"{lead} {name}", label, lead in HELD_LEADS) for lead in LEADS + HELD_LEADS for name in NAMES[family]]
        for k, notice in enumerate(NOTICES.get(family, [])):
            w = notice.split()
            cuts = [w, w[: 2 * len(w) // 3], w[len(w) // 3 :], *[w[:i] + w[i + 1 :] for i in range(len(w))]]
            rows += [(" ".join(c), label, k > 0 and k == len(NOTICES[family]) - 1) for c in cuts]
    unknown = labels[UNKNOWN]
    rows += [(f"{lead} {o}", unknown, k >= len(OTHERS) // 2) for k, o in enumerate(OTHERS) for lead in (LEADS, HELD_LEADS)[k >= len(OTHERS) // 2]]
    rows += [(t, unknown, k % 4 == 3) for k, t in enumerate(ORDINARY)]
    base = spark.createDataFrame(rows, "template string, label double, held boolean")
    heads, tails = [F.array(*[F.lit(x) for x in xs]) for xs in (("", "copyright 2020 the authors "), ("", " see the file for details", " der text ist frei"))]
    made = base.withColumn("head", F.explode(heads)).withColumn("tail", F.explode(tails))
    return made.select(F.concat("head", "template", "tail").alias("paragraph"), "label", "held").distinct()


def learn(spark: SparkSession) -> tuple[CountVectorizerModel, LogisticRegressionModel, float]:
    """Vocabulary, regression, and the probability from which a family is right in PRECISION of the held cases."""
    rows = with_grams(training(spark)).select("grams", "label", "held").coalesce(4)
    grams = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(rows)
    rows = grams.transform(rows).cache()
    regression = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60)
    held = regression.fit(rows.where("not held")).transform(rows.where("held")).select("label", "prediction", F.array_max(vector_to_array("probability")).alias("p"))
    known = held.where(F.col("prediction") < len(FAMILIES)).select("p", (F.col("label") == F.col("prediction")).cast("int").alias("right"))
    steps = known.select(F.explode(F.sequence(F.lit(10), F.lit(19))).alias("k"), "p", "right").where(F.col("p") * 20 >= F.col("k"))
    good = steps.groupBy("k").agg(F.avg("right").alias("precision")).where(F.col("precision") >= PRECISION).agg(F.min("k")).first()[0]
    model = regression.fit(rows)
    rows.unpersist()
    return grams, model, (good or 19) / 20


def named(words: Column) -> Column:
    """The families whose names stand among the words, once each in order of the first: of names that overlap the longest counts.

    "Public domain of" and "all rights reserved for" speak of something else.
    """
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    of = {name: family for family, names in NAMES.items() for name in names}
    longest = sorted(of, key=lambda n: (-len(n), n))
    found = F.regexp_extract_all(text, F.lit("(?<= )(" + "|".join(longest) + ")(?= )(?!(?<=public domain) of )(?!(?<=rights reserved) for )"), F.lit(1))
    families = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    return F.array_distinct(F.transform(found, lambda n: F.element_at(families, n)))


#: A licence that is said not to hold, as words_of gives it.
DENIED = r" (?:not|never|nor|neither|isn t|aren t|wasn t|no longer)(?: (?:be|been|being|yet|now|currently|itself))*(?: (?:licensed|released|distributed|published|available|covered|governed|provided|offered|dedicated))? (?:under|by|in|to)(?: the| a| an| terms| of)* "


def denied(words: Column) -> Column:
    """Whether the words deny a licence."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).rlike(DENIED)


def contained(words: Column, family: Column) -> Column:
    """1 if a name of the family stands among the words, else the largest share of a notice's word pairs that do."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    share = F.lit(0.0)
    for f in FAMILIES:
        shares = [F.lit(0.0), F.lit(0.0)]
        for notice in NOTICES.get(f, []):
            w = notice.split()
            wanted = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
            shares.append(F.size(F.array_intersect(pairs, F.array(*[F.lit(p) for p in wanted]))) / len(wanted))
        share = F.when(family == f, F.greatest(*shares)).otherwise(share)
    return F.when(F.array_contains(named(words), family), F.lit(1.0)).otherwise(share)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, paragraph, family, probability, contained, confirmed, families) of each paragraph with a licence word; line is that of the first such word.

    The regression tells whether a paragraph states a licence; names in it tell which, and without a name or against one a whole notice does.
    A licence that is denied is unknown.  families are all that are named, family first.
    """
    grams, model, believed = learn(docs.sparkSession)
    found = docs.where(F.col(text).rlike(ANCHOR)).select(F.col(key), F.split(F.col(text), BETWEEN).alias("_parts"))
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    found = found.withColumn("_before", prefix_sums(F.transform("_parts", newlines)))
    parts = F.filter(F.arrays_zip("_parts", "_before"), lambda s: s["_parts"].rlike(ANCHOR))
    found = found.select(key, F.explode(parts).alias("s"))
    line = (F.col("s._before") + newlines(F.split("s._parts", ANCHOR, 2)[0])).cast("int")
    found = found.select(key, line.alias("line"), F.regexp_replace("s._parts", r"^\s+|\s+$", "").alias("paragraph"))
    scored = model.transform(grams.transform(with_grams(found)))
    names = F.array(*[F.lit(f) for f in [*FAMILIES, UNKNOWN]])
    p = vector_to_array("probability")
    scored = scored.select(key, "line", "paragraph", "words", F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1).alias("likeliest"), F.array_max(p).alias("top"), (1 - F.get(p, F.lit(len(FAMILIES)))).alias("any"), named(F.col("words")).alias("named"), denied(F.col("words")).alias("denied"))
    # Families share n-grams, and so their probability: where a name stands the regression tells whether the paragraph states a licence at
    # all, and the name which; else it tells both.
    by_name = F.size("named") > 0
    probability = F.when(by_name, F.col("any")).otherwise(F.col("top"))
    scored = scored.withColumn("probability", probability).withColumn("share", contained(F.col("words"), F.col("likeliest")))
    which = F.when(by_name & ~(F.array_contains("named", F.col("likeliest"))) & (F.col("share") < LEAST_CONTAINED), F.col("named")[0]).otherwise(F.col("likeliest"))
    family = F.when((F.col("probability") >= believed) & ~F.col("denied"), which).otherwise(F.lit(UNKNOWN))
    scored = scored.withColumn("family", family)
    held = F.when(F.col("family") == UNKNOWN, 0.0).when(F.array_contains("named", F.col("family")), 1.0).otherwise(F.col("share"))
    families = F.when(F.col("family") == UNKNOWN, F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array("family"), "named")))
    scored = scored.withColumn("contained", F.round(held, 4))
    return scored.select(key, "line", "paragraph", "family", F.round("probability", 4).alias("probability"), "contained", (F.col("contained") >= LEAST_CONTAINED).alias("confirmed"), families.alias("families"))
