"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

Trees are grown over document statistics, their paths become conjunctive rules, a logistic model with an
L1 penalty keeps a few of them, and these are evaluated in the JVM for every document.
"""

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptmill.llm.common import held_out, stage, table

#: labelled rows a model is fitted on at most, those with the smallest hash of their id
SAMPLE_ROWS = 20_000
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.002, 7
#: a document is predicted to be good from this score on
THRESHOLD = 0.3

STATISTICS = ["chars", "words", "upper", "digits", "symbols", "points", "shouts", "blanks", "word_size",
              "own_words", "variety", "own_lines", "line_words"]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of whole texts; null counts as empty, shares of nothing are 0."""
    text = F.coalesce(text, F.lit(""))
    size, words, lines = F.length(text), F.split(F.trim(text), "\\s+"), F.split(text, "\n")
    own = F.size(F.array_distinct(words))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    def of_class(pattern: str) -> Column:
        return share(size - F.length(F.regexp_replace(text, f"[{pattern}]+", "")), size)

    return dict(zip(STATISTICS, [
        F.log1p(size.cast("double")),
        F.log1p(F.size(words).cast("double")),
        of_class("\\p{Lu}"),
        of_class("\\p{N}"),
        of_class("^\\p{L}\\p{N}\\s.,;:'\"!?()-"),
        of_class(".,;:"),
        of_class("!?"),
        of_class("\\s"),
        share(size, F.size(words)),
        share(own, F.size(words)),
        share(F.log1p(own.cast("double")), F.log1p(F.size(words).cast("double"))),
        share(F.size(F.array_distinct(lines)), F.size(lines)),
        share(F.size(words), F.size(lines)),
    ], strict=True))


def tree_rules(debug: str) -> set[tuple]:
    """The paths of Spark's printed trees: each a sorted tuple of (feature, is greater, threshold)."""
    rules, path = set(), []
    for line in debug.splitlines():
        depth = len(line) - len(line.lstrip())
        if m := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            path = [p for p in path if p[0] < depth] + [(depth, (int(m[1]), m[2] == ">", float(m[3])))]
            rules.add(tuple(sorted({condition for _, condition in path})))
        elif line.lstrip().startswith("Tree"):
            path = []
    return rules


def rule_column(rule: tuple) -> Column:
    """1.0 where all conditions of the rule hold, else 0.0."""
    holds = F.lit(True)
    for feature, greater, threshold in rule:
        value = F.col(STATISTICS[feature])
        holds = holds & (value > threshold if greater else value <= threshold)
    return holds.cast("double")


def training_sample(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str,
                    rows: int) -> DataFrame:
    """Statistics and label of at most `rows` labelled rows outside the held-out fifth.

    The bound makes the id list small enough to be broadcast; texts are not shuffled.
    """
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_label")).where(
        "_id is not null and _label in (0, 1)").where(~held_out(F.col("_id"))).groupBy("_id").agg(
        F.max("_label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return stage(texts.join(F.broadcast(chosen), "_id").select(
        F.array(*statistics(F.col("_text")).values()).alias("stats"), "label"), "quality-sample")


def fit_rules(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY):
    """(intercept, [(weight, rule)]) of the fitted ensemble; a constant where a class is missing."""
    found = sample.agg(F.sum("label"), F.count("*")).first()
    good, rows = found[0] or 0, found[1]
    if good in (0, rows):
        return (0.0 if not rows else 4.0 if good else -4.0), []
    vectors = sample.coalesce(4).select(array_to_vector("stats").alias("features"), "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird",
                                    minInstancesPerNode=5).fit(vectors)
    rules = sorted(tree_rules(forest.toDebugString))
    if not rules:
        return math.log(good / (rows - good)), []
    named = sample.coalesce(4).select("label", *(F.col("stats")[i].alias(n) for i, n in enumerate(STATISTICS)))
    marks = named.select("label", array_to_vector(F.array(*map(rule_column, rules))).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(marks)
    weights = model.coefficients.toArray().tolist()
    return float(model.intercept), [(w, r) for w, r in zip(weights, rules, strict=True) if w]


def score_quality(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  label: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `documents`.

    Fitted on at most `rows` labelled rows whose crc32(doc_id) mod 5 is not 0; of several labels for one id
    the largest counts, null or other labels are skipped. Only the text enters a score. Null and empty texts
    get the score of their (zero) statistics, rows with a null id count as held out, repeated rows give
    repeated results, and an empty or one-sided set of labels gives one constant score. Other columns are not read.
    """
    intercept, rules = fit_rules(training_sample(documents, labels, doc_id, text, label, rows))
    stats = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).select(
        "_id", *(c.alias(n) for n, c in statistics(F.col("_text")).items()))
    logit = F.lit(intercept)
    for weight, rule in rules:
        logit = logit + rule_column(rule) * F.lit(weight)
    score = 1 / (1 + F.exp(-logit))
    return stats.select(F.col("_id").alias(doc_id), held_out(F.col("_id")).alias("held_out"),
                        score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
