"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates. DataFrame operations only.

A paragraph is a run of lines between blank ones, its lines joined, so that a wrapped notice is whole; in a paragraph of
several lines each line is looked at by itself, too. A multinomial logistic regression over sparse counts of word 1-, 2- and
3-grams is trained on notices of each family and on paragraphs that only sound like them, which are the unknown class. Other
notices and paragraphs, none of them in training, set the least probability that counts (``calibrate``). A predicted family is
confirmed if the paragraph shares a distinctive word pair and at least ``CONFIRM`` of the word pairs, its own or the
notice's, with one notice of that family.

Distinctive are the notices' word pairs with a word that is not in ``COMMON``. A paragraph without any cannot be confirmed by
that rule, and is no candidate: it is not given to the classifier. Nothing else keeps a paragraph from it.

Texts are taken whole, however long; a long paragraph is one row of word n-grams.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiewright.llm.bpe import whole_text

UNKNOWN = "unknown"
#: Share of a paragraph's, or of a notice's, word pairs that must agree.
CONFIRM = 0.5
#: Notices by family, as they stand in files. Fixed values.
NOTICES = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This product is distributed under the Apache License Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD License.",
        "This software is licensed under the 3-clause BSD license.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Content is available under the Creative Commons Attribution license.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Released under CC BY-NC 3.0.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL version 2.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Released under the LGPL version 3.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license.",
        "The MIT License (MIT)",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "This document is proprietary and confidential; unauthorized copying is prohibited. All rights reserved.",
    ),
}
#: Paragraphs of the unknown class: of the same words, and no licence.
OTHERS = (
    "The driver must show a valid license to the officer.", "Her fishing license expired in May.", "Licensed plumbers and electricians are listed below.",
    "He was granted permission to leave the camp.", "The warranty covers parts and labour for two years.", "The general public was not admitted to the apache dance.",
    "The book was released in March and distributed to schools.", "A free copy of the software came with the magazine.", "The library lends books under the terms of the city.",
    "The Mozilla festival is open to the public.", "MIT researchers published a paper on foundations of software.", "The GNU is an antelope.",
    "Version 2.0 of the file is out.", "The terms of the treaty were published by the foundation.", "Copyright law has a long history in Europe.",
    "Source and binary stars are permitted on the list.", "The commons were enclosed in 1801.", "Attribution of the painting is disputed.",
    "They were creative and common sense prevailed.", "All rights and duties pass to the heirs.", "Use of this road is governed by the council.",
    "Poetic license is allowed here.", "Licensing fees rose again last year.", "The public domain of the king was sold.",
)
#: Notices and paragraphs for the least probability; none of them is in training.
CALIBRATION = {
    "Apache": ("Distributed under the terms of the Apache License 2.0, see LICENSE.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "The code is covered by Apache License, Version 2.0."),
    "BSD": ("Redistributions of source code must retain the above copyright notice; redistribution and use in source and binary forms are permitted.", "This module is governed by a BSD-style license.", "Available under the 2-clause BSD license."),
    "CC-BY": ("The figures are licensed under a Creative Commons Attribution 3.0 International License.", "Shared under CC BY 3.0."),
    "CC-BY-NC": ("The photographs are licensed under a Creative Commons Attribution-NonCommercial 3.0 License.", "Shared under CC BY-NC 2.0."),
    "CC-BY-SA": ("The article is available under the Creative Commons Attribution-ShareAlike 3.0 License.", "Shared under CC BY-SA 3.0."),
    "CC0": ("The authors have waived all copyright and related rights under CC0 1.0.", "The data are dedicated to the public domain."),
    "GPL": ("You can redistribute it under the terms of the GNU General Public License version 2.", "Licensed under the GNU GPL version 3 or later."),
    "LGPL": ("The library is released under the GNU Lesser General Public License, version 3.", "You may use this library under the terms of the LGPL version 2.1."),
    "MIT": ("This package is licensed under the terms of the MIT license.", "Permission is granted, free of charge, to any person obtaining a copy of this software."),
    "MPL": ("The file is subject to the Mozilla Public License version 2.0.", "Distributed under the Mozilla Public License, v. 2.0."),
    "proprietary": ("All rights reserved. Unauthorized copying of this file is prohibited.", "Proprietary and confidential. All rights reserved."),
    UNKNOWN: (
        "You need a license to drive a lorry in most countries.", "The permission slip was signed by both parents.", "Source code was printed in the back of the magazine.", "The public may copy old maps at the library.",
        "He reserved all the rooms of the hotel.", "The software came free of charge with the printer.", "A creative license to film was granted in common by the towns.", "The terms of use of the pool are posted at the door.",
        "Mozilla released version 2.0 of the browser in October.", "The foundation published its report on general practice.", "The Berkeley campus lies on a hill.", "Apache helicopters landed north of the city.",
    ),
}
#: Words that make no pair distinctive.
COMMON = frozenset("a all also an and any are as at be been but by can each for from has have he her his if in into is it its may more most must no not of on one only or other our out same she should so some such than that the their them then there these they this those to under up use used was we were which who will with without work you your".split())


def words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(ws: Column, n: int) -> Column:
    """The n-grams of an array of words, empty if it is shorter."""
    if n == 1:
        return ws
    length = F.greatest(F.size(ws) - n + 1, F.lit(0))
    grams = ws
    for k in range(1, n):
        grams = F.zip_with(F.slice(grams, F.lit(1), length), F.slice(ws, F.lit(k + 1), length), lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def _pairs(paragraph: str) -> list[str]:
    """The distinct word pairs of a notice."""
    ws = [w for w in re.split(r"[^A-Za-z0-9]+", paragraph.lower()) if w]
    return list(dict.fromkeys(map(" ".join, zip(ws, ws[1:]))))


DISTINCTIVE = sorted({p for notices in NOTICES.values() for n in notices for p in _pairs(n) if not COMMON.issuperset(p.split())})
#: Every distinctive pair has one of these words.
CONTENT = sorted({w for p in DISTINCTIVE for w in p.split()} - COMMON)


def features(paragraph: Column) -> Column:
    ws = words(paragraph)
    return F.concat(*(ngrams(ws, n) for n in (1, 2, 3)))


def _table(spark: SparkSession, paragraphs: dict[str, tuple[str, ...]], around: list) -> DataFrame:
    """(label, paragraph): the paragraphs of each family, each as ``around`` says."""
    families = [UNKNOWN, *NOTICES]
    entries = [(families.index(f), p) for f, listed in paragraphs.items() for p in listed]
    base = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(float(i)).alias("label"), F.lit(p).alias("paragraph")) for i, p in entries])).alias("x")).select("x.*")
    return base.select("label", F.explode(F.array(*[a(F.col("paragraph")) for a in around])).alias("paragraph"))


def training_table(spark: SparkSession) -> DataFrame:
    """(label, paragraph) for the fit: the notices and the unknown paragraphs, each also inside other words."""
    around = [lambda p: p, lambda p: F.concat(F.lit("Note. "), F.upper(p)), lambda p: F.concat(F.lit("This file: "), p, F.lit(" See the notice for details.")), lambda p: F.concat(F.lit("Unless stated otherwise, "), F.lower(p), F.lit(" Contact the author."))]
    return _table(spark, {UNKNOWN: OTHERS, **NOTICES}, around)


def calibration_table(spark: SparkSession) -> DataFrame:
    """(label, paragraph) for the least probability."""
    return _table(spark, CALIBRATION, [lambda p: p, lambda p: F.concat(F.lit("About the files. "), p)])


class LicenceClassifier:
    """Vocabulary, regression and least probability, trained on the built-in notices."""

    def __init__(self, spark: SparkSession):
        self.families = [UNKNOWN, *NOTICES]
        with_ngrams = lambda t: t.withColumn("ngrams", features(F.col("paragraph"))).coalesce(1)  # noqa: E731  a fixed list
        table = with_ngrams(training_table(spark))
        self.vectorizer = CountVectorizer(inputCol="ngrams", outputCol="vector", binary=True, minDF=2.0).fit(table)
        self.model = LogisticRegression(featuresCol="vector", maxIter=40, regParam=0.005, family="multinomial").fit(self.vectorizer.transform(table))
        self.least = self.calibrate(with_ngrams(calibration_table(spark)))

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ngrams) with the array ``probability``, by family."""
        scored = self.model.transform(self.vectorizer.transform(rows))
        return scored.withColumn("probability", vector_to_array("probability")).drop("vector", "rawPrediction", "prediction")

    def calibrate(self, rows: DataFrame) -> float:
        """Half way between the surest wrong family and the least sure right one, within 0.3 to 0.9."""
        best = F.array_max(F.slice("probability", 2, len(self.families) - 1))
        right = F.element_at("probability", F.col("label").cast("int") + 1) == best
        wrong, sure = self.probabilities(rows).agg(F.max(F.when((F.col("label") == 0) | ~right, best)), F.percentile(F.when((F.col("label") > 0) & right, best), 0.05)).first()
        return min(0.9, max(0.3, ((wrong or 0.3) + (sure or 0.9)) / 2))

    def classify(self, paragraphs: DataFrame) -> DataFrame:
        """``paragraphs`` (column paragraph, null allowed) with family, probability and confirmed.

        family is unknown below the calibrated probability. confirmed: a distinctive pair, and at least CONFIRM of the
        paragraph's word pairs or of a notice's, agree with one notice of the family.
        """
        rows = self.probabilities(paragraphs.withColumn("ngrams", features(F.coalesce("paragraph", F.lit("")))))
        likely = F.slice("probability", 2, len(self.families) - 1)
        rows = rows.withColumn("best", F.array_max(likely)).withColumn("family", F.element_at(F.array(*map(F.lit, NOTICES)), F.array_position(likely, F.col("best")).cast("int")))
        rows = rows.withColumn("pairs", F.array_distinct(ngrams(words(F.coalesce("paragraph", F.lit(""))), 2)))

        def agrees(notice: str) -> Column:
            own = _pairs(notice)
            shared = F.size(F.array_intersect("pairs", F.array(*map(F.lit, own))))
            return shared >= CONFIRM * F.least(F.size("pairs"), F.lit(len(own)))

        confirmed = F.lit(False)
        for family, notices in NOTICES.items():
            confirmed = F.when(F.col("family") == family, reduce(lambda a, b: a | b, map(agrees, notices))).otherwise(confirmed)
        sure = F.col("best") >= self.least
        rows = rows.withColumn("confirmed", sure & F.arrays_overlap("pairs", F.array(*map(F.lit, DISTINCTIVE))) & confirmed)
        return rows.withColumn("family", F.when(sure, F.col("family")).otherwise(UNKNOWN)).withColumn("probability", F.col("best")).drop("best", "ngrams", "pairs")


_fitted: dict[str, LicenceClassifier] = {}


def classifier_of(spark: SparkSession) -> LicenceClassifier:
    """The classifier of this application, fitted once."""
    name = spark.sparkContext.applicationId
    if name not in _fitted:
        _fitted[name] = LicenceClassifier(spark)
    return _fitted[name]


LINE_END = r"(?:\r\n|\r|\n)"
BLANK = rf"{LINE_END}[ \t]*{LINE_END}\s*"


def scan(docs: DataFrame, classifier: LicenceClassifier | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_paragraphs, n_candidates, n_confirmed, licence, probability, licences.

    Counts are of paragraphs; one is confirmed if it or one of its lines is. licence is the confirmed family with the highest
    probability (ties: the last by name), unknown if there are candidates and none is confirmed, and null if there are no
    candidates; licences are all confirmed families. Null and empty texts have no paragraphs. Repeated rows give repeated
    results; an empty table gives none; other columns are not read.
    """
    classifier = classifier or classifier_of(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("body"))
    blocks = F.filter(F.split("body", BLANK), lambda p: F.btrim(p, F.lit(" \t\r\n")) != "")
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), blocks.alias("blocks"))
    rows = rows.select("doc_id", "row", F.size("blocks").cast("long").alias("n_paragraphs"), F.filter("blocks", lambda p: F.exists(words(p), lambda w: w.isin(CONTENT))).alias("some"))
    distinctive = F.array(*map(F.lit, DISTINCTIVE))
    candidate = lambda p: F.arrays_overlap(ngrams(words(p), 2), distinctive)
    rows = rows.select("doc_id", "row", "n_paragraphs", F.posexplode_outer(F.filter("some", candidate)).alias("at", "block"))
    lines = F.filter(F.split("block", LINE_END), lambda p: F.btrim(p) != "")
    units = F.when(F.size(lines) > 1, F.concat(F.array("block"), F.filter(lines, candidate))).otherwise(F.array("block"))
    found = classifier.classify(rows.select("doc_id", "row", "n_paragraphs", "at", F.explode(units).alias("paragraph")))
    best = F.max(F.when(F.col("confirmed"), F.struct(F.col("probability"), F.col("family"))))
    out = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_paragraphs").alias("n_paragraphs"), F.count_distinct("at").alias("n_candidates"), F.count_distinct(F.when(F.col("paragraph").isNotNull() & F.col("confirmed"), F.col("at"))).alias("n_confirmed"),
        best.alias("best"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licences"),
    )
    licence = F.when(F.col("n_confirmed") > 0, F.col("best.family")).when(F.col("n_candidates") > 0, F.lit(UNKNOWN))
    return out.select("doc_id", "n_paragraphs", "n_candidates", "n_confirmed", licence.alias("licence"), F.round("best.probability", 6).alias("probability"), "licences")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
