"""verdant: farm-sustainability, tabular-prediction and sensor-stream analytics on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` (or ``Column``) function built from
the DataFrame / SQL API so that Catalyst can prune, push down and plan it.
"""

from verdant.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
