"""modelgate: Spark-native model evaluation, drift measurement and promotion gating.

Every operator takes and returns DataFrames. Model-level results are keyed by
``(model_name, model_version)`` so one job evaluates and gates a whole fleet of
candidate versions.
"""

from modelgate.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
