"""Column expressions: text, dates, URLs and hashes, all evaluated by Catalyst."""

from pyspark.sql import SparkSession


def search_names(spark: SparkSession) -> list[str]:
    """Registers the two functions that need Python, as pandas UDFs."""
    from ..operators.search import stem
    from .text import _nfkc

    spark.udf.register("nfkc", _nfkc)
    spark.udf.register("stem_word", stem)
    return ["nfkc", "stem_word"]
