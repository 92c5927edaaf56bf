"""The feature extractor as a stage of an ML pipeline."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from . import html_features


class PageFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the numeric features and both text channels of an html column, joined on an id that is unique."""

    idCol = Param(Params._dummy(), "idCol", "id of a page", TypeConverters.toString)
    htmlCol = Param(Params._dummy(), "htmlCol", "html of a page", TypeConverters.toString)

    def __init__(self, idCol: str = "page_id", htmlCol: str = "html"):
        super().__init__()
        self._setDefault(idCol="page_id", htmlCol="html")
        self._set(idCol=idCol, htmlCol=htmlCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, html = self.getOrDefault(self.idCol), self.getOrDefault(self.htmlCol)
        return dataset.join(html_features.features(dataset, key, html), key).join(html_features.text_channels(dataset, key, html), key)
