"""Licence scan: a trained paragraph classifier whose answers templates confirm."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.ordering import quantiles
from auditloom.session import materialise

# Wording of public licence notices, by family.
NOTICES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright (c) Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *NOTICES]
BACKGROUND = 2000.0  # weight of all paragraphs together, at most; a notice has 40
TASK_SETS = 50_000
LONG_WORDS = 120
CONFIRM = 0.7
FALSE_ALARMS = 0.001


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, passage``: text between blank lines, and the lines of paragraphs over 120 words."""
    blocks = F.split(F.coalesce("text", F.lit("")), "\n[ \\t\\r]*\n")
    parts = F.flatten(F.transform(blocks, lambda b: F.when(F.size(F.split(b, " ")) > LONG_WORDS, F.split(b, "\n")).otherwise(F.array(b))))
    return docs.select("doc_id", F.posexplode(parts).alias("paragraph", "passage")).where(F.trim("passage") != "")


def words(passage: Column) -> Column:
    """Lower-case words; dots and hyphens inside names and numbers stay."""
    # found, not split: splitting at the gaps took five times as long; a greedy group would recurse once a dot
    return F.regexp_extract_all(F.lower(passage), F.lit("[.-]?[a-z0-9]++(?:[.-][a-z0-9]++)*+"), F.lit(0))


def grams(tokens: str) -> Column:
    """Distinct words and pairs of neighbouring words."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.array_distinct(F.concat(tokens, F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))))


def templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("passage")) for f, notices in NOTICES.items() for t in notices])
    return spark.range(1).select(F.inline(rows)).withColumn("tokens", words(F.col("passage"))).withColumn("grams", grams("tokens"))


class Model:
    """Vocabulary, regression and the least probability at which a family is named. ``fit`` makes it."""

    def __init__(self, vocabulary: CountVectorizerModel, regression: LogisticRegressionModel, floor: float):
        self.vocabulary, self.regression, self.floor = vocabulary, regression, floor

    def probabilities(self, passages: DataFrame) -> DataFrame:
        """Adds ``chances``, the probability of each of ``FAMILIES``, to rows with ``features``."""
        scored = self.regression.transform(passages)
        return scored.withColumn("chances", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")


def _notices(spark: SparkSession) -> list[tuple[str, list[str]]]:
    """The templates' n-grams: a fixed small table."""
    return [(r[0], r[1]) for r in templates(spark).select("family", "grams").collect()]


def _vocabulary(notices: list[tuple[str, list[str]]]) -> CountVectorizerModel:
    """All n-grams of the notices."""
    return CountVectorizerModel.from_vocabulary(sorted({g for _, gs in notices for g in gs}), "grams", "features", binary=True)


def _numbered(notices: list[tuple[str, list[str]]], vocabulary: CountVectorizerModel) -> list[tuple[str, Column]]:
    """Families with the places of their notices' n-grams in the vocabulary, which holds them all."""
    place = {g: i for i, g in enumerate(vocabulary.vocabulary)}
    return [(f, F.array(*[F.lit(place[g]) for g in gs])) for f, gs in notices]


def _held() -> Column:
    return F.unwrap_udt("features")["indices"]


def _similarity(notices: list[tuple[str, Column]]) -> Column:
    """Largest share of a notice of the family that the passage holds."""
    table = F.array(*[F.struct(F.lit(f).alias("f"), g.alias("g")) for f, g in notices])
    shares = F.transform(F.filter(table, lambda t: t["f"] == F.col("family")), lambda t: F.size(F.array_intersect(t["g"], _held())) / F.size(t["g"]))
    return F.coalesce(F.array_max(shares), F.lit(0.0))


def marked(docs: DataFrame, vocabulary: CountVectorizerModel) -> DataFrame:
    """``doc_id, paragraph, passage, features``: all paragraphs with the n-grams of notices they hold."""
    parts = paragraphs(docs).withColumn("tokens", words(F.col("passage")))
    return vocabulary.transform(parts.withColumn("grams", grams("tokens")).drop("tokens")).drop("grams")


def fit(docs: DataFrame, parts: DataFrame | None = None) -> Model:
    """Train on the notices and on all paragraphs.

    The notices, whole and by halves, are the families. The unknown class is
    every paragraph that does not hold most of a notice; paragraphs with the same
    n-grams of notices are one row with their number as weight, and all together
    weigh ``BACKGROUND`` at most. A third of the texts is kept back: the least
    probability for naming a family is set so that at most ``FALSE_ALARMS`` of
    these would be named, and to one half at least. ``parts`` are the ``marked``
    paragraphs of ``docs`` where they are written already.
    """
    spark = docs.sparkSession
    notices = _notices(spark)
    vocabulary = _vocabulary(notices)
    known = templates(spark)
    half = F.ceil(F.size("tokens") / 2).cast("int")
    cuts = F.explode(F.array(F.col("tokens"), F.when(F.size("tokens") > 12, F.slice("tokens", F.lit(1), half)), F.when(F.size("tokens") > 12, F.slice("tokens", half + 1, half)))).alias("tokens")
    known = vocabulary.transform(known.select("family", cuts).where("tokens IS NOT NULL").withColumn("grams", grams("tokens")))
    draw = F.pmod(F.xxhash64("passage"), F.lit(3))
    ground = (marked(docs, vocabulary) if parts is None else parts).groupBy("features").agg(
        F.count_if(draw > 0).alias("trained"), F.count_if(draw == 0).alias("kept_back"))
    whole = F.array(*[g for _, g in _numbered(notices, vocabulary)])
    most = F.exists(whole, lambda g: (F.size(_held()) >= 0.6 * F.size(g)) & (F.size(F.array_intersect(g, _held())) >= 0.6 * F.size(g)))
    # a filter here would move below the aggregate and find the n-grams again for each notice
    ground = materialise(ground.withColumn("notice", most), "licence-ground").where("NOT notice")
    total, sets = ground.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count_if(F.col("trained") > 0)).first()
    weight = F.col("trained") * F.lit(min(1.0, BACKGROUND / max(total, 1)))
    train = known.select("family", "features", F.lit(40.0).alias("weight")).unionByName(
        ground.where("trained > 0").select(F.lit(UNKNOWN).alias("family"), "features", weight.alias("weight")))
    place = F.create_map(*[x for i, f in enumerate(FAMILIES) for x in (F.lit(f), F.lit(float(i)))])
    train = train.withColumn("label", place[F.col("family")])
    tasks = -(-sets // TASK_SETS)
    train = train.repartition(tasks) if tasks > 1 else train.coalesce(1)
    regression = LogisticRegression(maxIter=40, regParam=0.02, elasticNetParam=0.2, family="multinomial", weightCol="weight").fit(train)
    model = Model(vocabulary, regression, 0.5)
    best = F.array_max(F.slice("chances", 2, len(FAMILIES) - 1)).alias("best")
    row = quantiles(model.probabilities(ground.where("kept_back > 0")).select(best, "kept_back"), "best", [1 - FALSE_ALARMS], weight="kept_back").first()
    model.floor = max(0.5, row["quantile"] if row else 0.0)
    return model


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per licence paragraph: ``doc_id, paragraph, family, probability, similarity, confirmed, passage``.

    Every paragraph of every whole text is classified by the regression. A family
    is named if it is the likeliest class and reaches the calibrated floor, or if
    the passage holds 70 % of the n-grams of one of its notices, which also
    confirms it.

    Null and empty texts have no paragraphs; repeated rows give their rows again;
    ties between families go to the first by name; other columns are ignored; an
    empty table gives no rows.
    """
    notices = _notices(docs.sparkSession)
    parts = marked(docs, model.vocabulary if model else _vocabulary(notices))
    if model is None:
        # written once: training reads the features of all paragraphs too
        parts = materialise(parts, "licence-paragraphs")
        model = fit(docs, parts)
    scored = model.probabilities(parts)
    likeliest = F.slice("chances", 2, len(FAMILIES) - 1)
    top = F.array_position(likeliest, F.array_max(likeliest)).cast("int")
    named = scored.withColumns({"family": F.element_at(F.array(*[F.lit(f) for f in FAMILIES[1:]]), top), "probability": F.array_max(likeliest)})
    named = named.withColumn("similarity", _similarity(_numbered(notices, model.vocabulary)))
    sure = (F.col("probability") >= model.floor) & (F.col("probability") >= F.get("chances", F.lit(0)))
    # a filter here would run split and regression twice: it would move below both
    kept = F.explode_outer(F.when(sure | (F.col("similarity") >= CONFIRM), F.array(F.lit(1)))).alias("__kept")
    named = named.select("doc_id", "paragraph", "family", "probability", "similarity", "passage", kept).where("__kept IS NOT NULL")
    return named.select("doc_id", "paragraph", "family", "probability", "similarity", (F.col("similarity") >= CONFIRM).alias("confirmed"), "passage")
