"""vellum: labelled text analytics as Spark DataFrame operators.

Message logs + a labelled spine -> look-back text datasets -> vectors (learned projection
trained with contrastive losses) -> classifiers -> exact ranking metrics. Every operator takes
and returns DataFrames; the work runs on executors.
"""

from vellum.session import checkpoint_dir, get_spark, require_columns

__all__ = ["checkpoint_dir", "get_spark", "require_columns"]
