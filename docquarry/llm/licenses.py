"""Licence statements in documents: a trained paragraph classifier, with DataFrame operations only."""
from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.joins import guarded_join
from docquarry.functions.text import let
from docquarry.llm.common import pick
from docquarry.llm.registry import query
from docquarry.session import cut, spread

UNKNOWN = "unknown"
#: Statements by which the families are known. Blanks stand for any white space, case does not matter.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License version 2",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain under CC0 1.0 Universal",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) 2024. All rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
    ),
    UNKNOWN: (
        "Permission to enter was granted by the school and the software was shown to all.",
        "A driving licence must be carried at all times and shown on request.",
        "The fishing license costs ten pounds and is valid for one season.",
        "He lost his license after the accident and may not drive this year.",
        "The public library is free for any person and open on all days.",
        "The general rights of the public were discussed in the second part of the work.",
        "Copyright law was the subject of the lecture, with examples from many countries.",
        "The warranty covers parts and labour for two years under normal conditions.",
        "The version of the story that was distributed in the village is not known.",
        "The foundation gave free copies of the source to the public.",
        "You may use this room under the conditions stated at the door.",
        "The license plate of the car was covered with mud.",
        "The rights to the film were reserved for a later date by the studio.",
        "Common people created the work in the creative quarter of the city.",
    ),
}
#: A paragraph with one of these words is judged whatever it says; any other if it resembles a template.
ANCHORS = ("license", "licence", "licensed", "licenses", "licensing", "copyright", "spdx", "gnu", "gpl", "lgpl", "agpl", "mit", "bsd", "apache", "mozilla",
           "creative", "cc", "cc0", "permission", "redistribute", "redistribution", "software", "rights", "domain", "warranties", "reproduced")
VARIANTS = 48  # training rows made of each template, by leaving words out
LEFT_OUT = 15  # of 100 words
UNKNOWN_SAMPLE = 5_000  # paragraphs of the corpus, far from all templates, that stand for the unknown class in training
CONFIRM = 0.6
PROBABILITY = 0.5
ERROR = 0.02  # of held-out unknown paragraphs that may be taken for a licence

_ANCHORED = r"(?i)(?<![a-z0-9])(?:" + "|".join(ANCHORS) + r")(?![a-z0-9])"


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits; dots within numbers stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[0-9]+(?:\.[0-9]+)*"), 0)


def grams(words: Column) -> Column:
    """Words, pairs and triples of neighbours, each once; the sparse features of a paragraph."""
    at = F.sequence(F.lit(1), F.size(words))

    def runs(n: int) -> Column:
        return F.filter(F.transform(at, lambda i: F.when(i + n - 1 <= F.size(words), F.array_join(F.slice(words, i, F.lit(n)), " "))), F.isnotnull)

    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(words, runs(2), runs(3))))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_paragraphs, lines): the lines of every row that are not blank,
    counted, with their positions and whether they have an anchor word."""
    plain = pick(docs, id=id_col, text=text_col)
    lines = F.expr("filter(transform(split(text, '\\n'), (x, i) -> struct(i AS n, x AS text)), p -> trim(p.text) != '')")
    listed = plain.select("id", F.coalesce(lines, F.array().cast("array<struct<n:int,text:string>>")).alias("lines"))
    return listed.select(F.monotonically_increasing_id().alias("row"), "id", F.size("lines").cast("long").alias("n_paragraphs"),
                         F.transform("lines", lambda p: F.struct(p["n"], p["text"], F.rlike(p["text"], F.lit(_ANCHORED)).alias("anchored"))).alias("lines"))


def candidates(rows: DataFrame) -> DataFrame:
    """(row, n, text, anchored): the paragraphs that can be statements. Those without an anchor word are only such if the
    comparison with the templates confirms them, so all of them are compared, and those that it cannot confirm end here."""
    said = rows.select("row", F.inline("lines"))
    others = said.filter("NOT anchored").select(F.struct("row", "n").alias("place"), tokens(F.col("text")).alias("words"))
    alike = resemblance(others, _templates(rows.sparkSession), "place").filter(F.col("similarity") >= CONFIRM)
    near = cut(alike.select("place.row", "place.n").distinct(), "licence_near")
    return said.filter("anchored").unionByName(guarded_join(said.filter("NOT anchored"), near, ["row", "n"], "left_semi", spread=F.col("row")).select(said.columns))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, n, text) for family, many in TEMPLATES.items() for n, text in enumerate(many)]
    return spark.createDataFrame(rows, "family string, template int, text string").withColumn("words", tokens(F.col("text")))


def training_rows(templates: DataFrame, far: DataFrame) -> DataFrame:
    """(label, words, held): the templates with words left out by hash, and the
    paragraphs ``far`` as unknown; a quarter is held for calibration."""
    made = templates.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).select(
        "family", "v", F.expr(f"filter(words, (w, i) -> v = 0 OR pmod(xxhash64(v, template, family, i), 100) >= {LEFT_OUT})").alias("words"))
    rows = made.select("family", "words", (F.col("v") % 4 == 3).alias("held")).union(
        far.select(F.lit(UNKNOWN), "words", F.pmod(F.xxhash64("words"), F.lit(4)) == 3))
    names = list(TEMPLATES)
    label = F.array_position(F.array(*map(F.lit, names)), F.col("family")) - 1
    return rows.select(label.cast("double").alias("label"), "words", "held")


def resemblance(rows: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """Best match of every row (key, words) with the templates of each family:
    common pairs of words over the pairs of the shorter of the two. The
    templates are a fixed list, so their table may be sent to all tasks."""
    def pairs(df: DataFrame, *columns: str) -> DataFrame:
        two = let(F.col("words"), lambda w: F.array_distinct(F.when(F.size(w) < 2, w).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))))
        return df.select(*columns, two.alias("g")).select(*columns, F.size("g").alias("size"), F.explode("g").alias("g"))

    known = pairs(templates.filter(F.col("family") != UNKNOWN), "family", "template").withColumnRenamed("size", "template_size")
    met = pairs(rows, key).join(F.broadcast(known), "g")
    per = met.groupBy(key, "size", "family", "template", "template_size").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(key, "family").agg(F.max(F.col("n") / F.least("size", "template_size")).alias("similarity"))


def classify(candidates: DataFrame) -> DataFrame:
    """(place, family, probability, similarity, confirmed) of every candidate (place, text, anchored).

    Trains on the templates and on a bounded sample of candidates with an anchor word that resemble
    none. Scores are divided by a temperature that fits the held-out rows best, and a
    family needs a probability above what ``ERROR`` of the held-out unknown rows
    reach, and one half; otherwise the family is unknown. A prediction is
    confirmed if the paragraph also resembles a template of that family."""
    spark = candidates.sparkSession
    templates = _templates(spark)
    worded = cut(candidates.withColumn("words", tokens(F.col("text"))).select("place", "words", "anchored"), "licence_words")
    alike = cut(resemblance(worded, templates, "place"), "licence_alike")
    near = alike.filter("similarity >= 0.3").select("place").distinct()
    far = worded.filter("anchored").join(near, "place", "left_anti").orderBy(F.xxhash64("words"), "place").limit(UNKNOWN_SAMPLE)
    rows = cut(training_rows(templates, far).withColumn("grams", grams(F.col("words"))), "licence_training")

    # the vocabulary is that of the fixed templates, so weights are a bounded table
    vocabulary = [r[0] for r in templates.select(F.explode(grams(F.col("words"))).alias("g")).distinct().orderBy("g").collect()]
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    logistic = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-3, elasticNetParam=0.0)
    model = logistic.fit(vectors.transform(rows.filter("NOT held")).select("label", "features"))
    names = list(TEMPLATES)
    matrix, constant = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = spark.createDataFrame([(g, [float(x) for x in matrix[:, k]]) for k, g in enumerate(vocabulary)], "g string, w array<double>")

    def scored(df: DataFrame, key: str) -> DataFrame:
        """Score of every class for every row (key, grams)."""
        hit = df.select(key, F.explode("grams").alias("g")).join(F.broadcast(weights), "g")
        sums = hit.groupBy(key).agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(names))])
        full = df.select(key).join(sums, key, "left")
        return full.select(key, F.array(*[F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + F.lit(float(constant[k])) for k in range(len(names))]).alias("s"))

    def chances(temperature: float) -> Column:
        top = F.array_max("s")
        e = F.transform("s", lambda x: F.exp((x - top) / temperature))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    test = cut(rows.filter("held").select("label", "grams").withColumn("place", F.monotonically_increasing_id()), "licence_held")
    held = cut(scored(test, "place").join(test.select("place", "label"), "place"), "licence_scores")
    grid = (0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0)
    losses = held.agg(*[F.avg(-F.log(F.greatest(F.get(chances(t), F.col("label").cast("int")), F.lit(1e-12)))).alias(f"t{k}") for k, t in enumerate(grid)]).first()
    temperature = min(zip([x if x is not None else 0.0 for x in losses], grid))[1]
    unknown = names.index(UNKNOWN)
    known = F.array_max(F.transform(chances(temperature), lambda x, i: F.when(i != unknown, x)))
    reached = held.filter(F.col("label") == unknown).agg(F.percentile(known, F.lit(1 - ERROR))).first()[0]
    least = max(PROBABILITY, min(0.95, reached or 0.0))

    chance = chances(temperature)
    best = scored(worded.withColumn("grams", grams(F.col("words"))), "place").withColumn("p", chance).withColumn(
        "k", F.array_position("p", F.array_max("p")) - 1).select("place", F.array_max("p").alias("probability"), F.get(
            F.array(*map(F.lit, names)), F.col("k").cast("int")).alias("likely"))
    family = F.when((F.col("likely") != UNKNOWN) & (F.col("probability") >= least), F.col("likely")).otherwise(F.lit(UNKNOWN)).alias("family")
    named = best.select("place", family, "probability").join(alike, ["place", "family"], "left")
    return named.select("place", "family", "probability", F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
                        ((F.col("family") != UNKNOWN) & (F.coalesce("similarity", F.lit(0.0)) >= CONFIRM)).alias("confirmed"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row, id, n_paragraphs) of the input, and statements (row, n, text,
    family, probability, similarity, confirmed): all paragraphs with an anchor word,
    and of all others those that are confirmed.

    Null and empty texts have no paragraphs; paragraphs are whole lines, however
    long; null ids and repeated rows are rows of their own; equal paragraphs
    are classified once; an empty table gives no rows."""
    rows = cut(paragraphs(docs, id_col, text_col), "licence_paragraphs")
    said = cut(candidates(rows).withColumn("digest", F.sha2("text", 256)), "licence_statements")
    once = said.groupBy("digest").agg(F.min("text").alias("text"), F.max("anchored").alias("anchored")).withColumnRenamed("digest", "place")
    judged = cut(classify(once), "licence_judged")
    # one statement may stand in a third of all rows; the table of different statements is joined by digest, which Spark splits
    return rows.select("row", "id", "n_paragraphs"), said.join(judged, said["digest"] == judged["place"]).filter("anchored OR confirmed").select(
        "row", "n", "text", "family", "probability", "similarity", "confirmed")


@query("op3_license_scan")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    rows, statements = scan_licenses(spread(spark.read.parquet(f"{sf}/documents.parquet")))
    sure = F.when(F.col("confirmed"), F.col("family"))
    per = statements.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_statements"), F.count(sure).alias("n_licenses"), F.array_join(F.array_sort(F.collect_set(sure)), ",").alias("families"),
        F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"))
    return rows.join(per, "row", "left").select(
        F.col("id").alias("doc_id"), "n_paragraphs", F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements"),
        F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("families", F.lit("")).alias("families"),
        F.round("probability", 4).alias("probability"))
