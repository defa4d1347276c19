"""Let Python workers run our functions without the package installed there."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    """Send the functions of this module with the job instead of by import."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
