"""Rule sets from JSON; categories keep their order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..functions.scoring import BASELINE, Rules


def load_rules(spark: SparkSession, path: str, baseline: float = BASELINE) -> Rules:
    """From a JSON file that Spark can read: {category: {keywords, sentences, filename_patterns}}."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return Rules.of(json.loads(text), baseline)


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    rows = [(c, i, kind, p) for i, (c, kinds) in enumerate(rules.categories.items()) for kind, patterns in kinds.items() for p in patterns]
    return spark.createDataFrame(rows, "category string, ord int, kind string, pattern string")
