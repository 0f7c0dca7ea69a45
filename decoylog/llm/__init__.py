"""Training-data operators over documents; nothing else in the library needs them.

Functions of this package that run inside tasks travel with the task, so the
executors need none of its files; what is broadcast is plain data.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from decoylog.llm.queries import oracle_sql, queries  # noqa: E402

__all__ = ["oracle_sql", "queries"]
