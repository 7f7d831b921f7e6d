"""Operations of a training-data pipeline, each a DataFrame to DataFrame function.

Nothing outside this package (but the optional wiring in ``__spark_entry__.py``
and ``corpus_pipeline.py``) imports it.  Worker code is pickled by value, so
executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
