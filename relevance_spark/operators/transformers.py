"""The encoder as a stage of Spark ML pipelines, and as the two calls that vector stores of other libraries make."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevance_spark.operators.encoders import Encoder, load_encoder


class TextEmbedder(Transformer):
    """inputCol of texts to outputCol of vectors; as_vector makes ML vectors for the stages after it."""

    def __init__(self, encoder: Encoder | str | dict = "hashing", inputCol: str = "text", outputCol: str = "vec", kind: str = "document", as_vector: bool = False):
        super().__init__()
        self.encoder, self.inputCol, self.outputCol, self.kind, self.as_vector = load_encoder(encoder), inputCol, outputCol, kind, as_vector

    def _transform(self, dataset: DataFrame) -> DataFrame:
        v = self.encoder.vectors(F.col(self.inputCol), self.kind)
        return dataset.withColumn(self.outputCol, array_to_vector(v) if self.as_vector else v)


@dataclass
class Embeddings:
    """embed_documents and embed_query over lists of texts that a caller holds."""

    spark: SparkSession
    encoder: Encoder

    def _embed(self, texts: list[str], kind: str) -> list[list[float]]:
        rows = self.spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("v", self.encoder.vectors(F.col("text"), kind))
        return [[float(x) for x in r.v] for r in rows.orderBy("i").collect()]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return self._embed(texts, "document")

    def embed_query(self, text: str) -> list[float]:
        return self._embed([text], "query")[0]
