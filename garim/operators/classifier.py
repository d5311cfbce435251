"""A document classifier on character n-grams: TF-IDF with document frequencies counted by Spark, and a logistic regression whose
gradients are summed over partitions. Nothing of the corpus goes through the driver but the weights, one for each of `SLOTS` slots.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 15
GRAMS = (2, 3)


def fit(labelled: DataFrame, text: str = "text", label: str = "label", rounds: int = 50, strength: float = 1e-3) -> PipelineModel:
    """A model of (text, label 0 or 1). A null text counts as empty; rows of other labels are left out."""
    stages: list = [RegexTokenizer(inputCol="_text", outputCol="_chars", pattern="(?s).", gaps=False, toLowercase=True, minTokenLength=1)]
    names = []
    for n in GRAMS:
        stages += [NGram(n=n, inputCol="_chars", outputCol=f"_grams_{n}")]
        names.append(f"_grams_{n}")
    stages += [
        SQLTransformer(statement=f"select *, concat({', '.join(names)}) as _grams from __THIS__"),
        HashingTF(inputCol="_grams", outputCol="_counts", numFeatures=SLOTS),
        IDF(inputCol="_counts", outputCol="_features", minDocFreq=2),
        LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_probability", maxIter=rounds, regParam=strength),
    ]
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(label).cast("double").alias("_label"))
    return Pipeline(stages=stages).fit(rows)


def scores(model: PipelineModel, df: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
    """df with the probability of label 1."""
    rated = model.transform(df.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    return rated.select(*[c for c in df.columns if c != name], vector_to_array("_probability")[1].alias(name))
