"""panelrd: cohort and threshold-study analytics on Spark DataFrames.

Every public operator takes DataFrames (and small parameter objects) and returns
a DataFrame.  The heavy work is expressed with built-in Spark expressions and
aggregates so that Catalyst/Tungsten plan and run it on the executors; only
small moment matrices (a few dozen numbers per specification) reach the driver,
where the k x k linear solves of the estimators happen.
"""

from panelrd.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
