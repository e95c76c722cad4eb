"""Operators for preparing training text: one module for each operator.

Nothing else in the library imports this subpackage.
"""

import os
import sys

from pyspark import cloudpickle


def _importable_by_tasks() -> bool:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    return root in [*path, os.getcwd()] or "site-packages" in root


if not _importable_by_tasks():
    # Tasks then get the code with the plan instead of importing it.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
