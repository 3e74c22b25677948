"""Scores of matchers and classifiers, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """M4: counts by true and guessed class."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """M3, M4: precision, recall, F1 and support of each class; one shuffle of counts."""
    cells = confusion(df, truth, guess)
    sides = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("said"), F.col("n").alias("support")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("support")))).alias("s")).select("s.*")
    total = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("said").alias("said"), F.sum("support").alias("support"))
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return total.select("label", p.alias("prec"), r.alias("recall"), f1(p, r).alias("f1"), "support")


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return per_class(df, truth, guess).agg(F.avg("f1").alias("macro_f1"))


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """M5: the expected calibration error over bins (lo, hi]; a confidence of 0 is in none but counts in the total."""
    by = df.groupBy(F.ceil(F.col(confidence) * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    return by.agg((F.sum(F.when(F.col("bin") > 0, F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)) / F.sum("n")).alias("ece"))


def set_scores(df: DataFrame, got: str, want: str) -> DataFrame:
    """M6: precision, recall and F1 over all rows' sets, and the mean overlap of each row's (1 where both are empty)."""
    tp, ng, nw = F.size(F.array_intersect(got, want)), F.size(F.array_distinct(got)), F.size(F.array_distinct(want))
    union = F.size(F.array_union(got, want))
    total = df.agg(F.sum(tp).alias("tp"), F.sum(ng).alias("ng"), F.sum(nw).alias("nw"), F.avg(F.when(union == 0, F.lit(1.0)).otherwise(tp / union)).alias("mean_iou"))
    p, r = ratio(F.col("tp"), F.col("ng")), ratio(F.col("tp"), F.col("nw"))
    return total.select(p.alias("prec"), r.alias("recall"), f1(p, r).alias("f1"), "mean_iou")


def drop_of(base: str, changed: str) -> Column:
    """M7: the mean drop, as an aggregate."""
    return F.avg(F.col(base) - F.col(changed))


def mean_drop(df: DataFrame, base: str, changed: str) -> DataFrame:
    """M7."""
    return df.agg(drop_of(base, changed).alias("mean_drop"))


def safety(df: DataFrame, truth: str, guess: str, negative, undecided) -> DataFrame:
    """M8, M9: wrong negatives, the share of undecided guesses, accuracy."""
    wrong = (F.col(guess) == F.lit(negative)) & (F.col(truth) != F.lit(negative))
    return df.agg(F.count_if(wrong).alias("wrong_negatives"), F.avg(wrong.cast("double")).alias("wrong_negative_rate"), F.avg((F.col(guess) == F.lit(undecided)).cast("double")).alias("undecided_rate"), F.avg((F.col(guess) == F.col(truth)).cast("double")).alias("accuracy"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    """M10."""
    return dot(a, b) / ((F.sqrt(dot(a, a)) + epsilon) * (F.sqrt(dot(b, b)) + epsilon))


def nearest_of_two(v: Column, first: Column, second: Column, names: tuple[str, str]) -> Column:
    """The nearer of two references, the first on a tie."""
    return F.when(cosine(v, first) >= cosine(v, second), names[0]).otherwise(names[1])


def softmax(v: Column) -> Column:
    """M13."""
    e = F.transform(v, lambda x: F.exp(x.cast("double") - F.array_max(v).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def masked_mean(v: Column, mask: Column) -> Column:
    """The mean of the values whose mask is 1."""
    total = dot(v, mask)
    return total / F.aggregate(mask, F.lit(0.0), lambda s, x: s + x.cast("double"))


def argmax_label(p: Column, labels: list[str]) -> Column:
    """M14."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(p, F.array_max(p)).cast("int"))


def perplexity(loss: Column) -> Column:
    """M15."""
    return F.exp(loss)


def fold_scores(df: DataFrame, group: str, correct: str, folds: int = 5) -> DataFrame:
    """The mean and deviation over folds of the share that is right; a group is in one fold as a whole."""
    from tessera.functions.hashing import hash_mod

    by = df.groupBy(hash_mod(["fold", F.col(group)], folds).alias("fold")).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return by.agg(F.count("*").alias("folds"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"))


def tfidf_baseline(train: DataFrame, test: DataFrame, text: str, label: str, most: int = 5000, c: float = 4.0) -> DataFrame:
    """Test with a prediction of a logistic regression over the TF-IDF of words and pairs of words, `most` of them.

    Labels are numbers from 0 on. c: the inverse strength of the regularisation, as a sum over rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer

    def tokens(df: DataFrame) -> DataFrame:
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\w\w+)"), F.lit(1))
        pairs = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.col("_w")[i + 1]))
        return df.withColumn("_w", words).withColumn("_t", F.concat("_w", pairs)).withColumn("_y", F.col(label).cast("double"))

    rows = tokens(train)
    n = max(1, rows.count())
    steps = [CountVectorizer(inputCol="_t", outputCol="_c", vocabSize=most), IDF(inputCol="_c", outputCol="_i"), Normalizer(inputCol="_i", outputCol="_n"), LogisticRegression(featuresCol="_n", labelCol="_y", predictionCol="prediction", maxIter=100, regParam=1 / (c * n))]
    return Pipeline(stages=steps).fit(rows).transform(tokens(test)).drop("_w", "_t", "_y", "_c", "_i", "_n", "rawPrediction", "probability")
