"""quire: the data work around language-model training, as Spark DataFrame operators.

Layout
------
functions/   column expressions (text, chat rendering, token-id rows, logits)
operators/   DataFrame -> DataFrame operators (reshape, rows, split, scoring,
             tokenizer, generation)
sources/     readers and writers (JSON lines with rejects, line index, splits)
plans/       the registered queries over the test tables and their SQL oracles
streaming/   the stateless corpus stages and running reports on Structured Streaming
"""

import sys as _sys

# Ship our UDF code to the Python workers by value, so executors need no
# installed copy of this package.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - an older cloudpickle: the package must be on the workers' path
    pass

from quire.session import get_spark, checkpoint_dir, scratch_dir  # noqa: E402,F401

__all__ = ["get_spark", "checkpoint_dir", "scratch_dir"]
