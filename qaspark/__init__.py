"""qaspark: a Spark-native question/answer relevance engine.

Text normalisation, pair generation, vocabularies, word-vector sentence
features, canonical-correlation projections, cosine ranking and ranking
evaluation, all expressed as DataFrame / SQL plans.
"""

from qaspark.session import get_spark, work_dir

__all__ = ["get_spark", "work_dir"]
