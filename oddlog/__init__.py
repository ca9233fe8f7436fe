"""oddlog: find unusual events in security and audit logs, on PySpark.

The package is a set of DataFrame transformations:

* ``sources``    read and write log tables, ingest state and trained models
* ``functions``  column expressions (time features, levels, scores, labels)
* ``operators``  DataFrame -> DataFrame steps (flatten, profile, select, encode, forest, detect, merge)
* ``plans``      the three jobs (collect, train, detect) and the registered queries
* ``streaming``  the same scoring and ingest steps on Structured Streaming
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
