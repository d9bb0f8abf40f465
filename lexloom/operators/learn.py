"""A trained text classifier inside the engine."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text


def train_and_predict(train: DataFrame, test: DataFrame, label: str, body: str = "text", features: int = 1 << 14, epochs: int = 20) -> DataFrame:
    """``test`` with ``predicted``: hashed term frequencies, IDF, multinomial logistic regression.

    The hashed terms of ``train`` are stored, so its texts are cut into words once, and the passes of the fit read numbers.
    """
    tokens = lambda df: df.withColumn("__tokens", text.tokens(F.coalesce(F.col(body), F.lit(""))))
    index = StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip", stringOrderType="alphabetAsc").fit(train)
    hashed = HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=features)
    known = storage.stored(hashed.transform(index.transform(tokens(train))).select("__label", "__tf"), "terms")
    stages = [IDF(inputCol="__tf", outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol="__label", predictionCol="__y", maxIter=epochs, regParam=0.01)]
    model = Pipeline(stages=stages).fit(known)
    named = IndexToString(inputCol="__y", outputCol="predicted", labels=index.labels).transform(model.transform(hashed.transform(tokens(test))))
    return named.select(*test.columns, "predicted")
