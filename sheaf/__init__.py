"""sheaf: document-block analytics on Spark.

Block tables in; pages, forms, tables, classified text lines, file triage,
usage and metrics out.  Every public operator is a DataFrame -> DataFrame
function; Catalyst plans the work.
"""

from sheaf.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
