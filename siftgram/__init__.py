"""siftgram: benchmark-overlap analytics over training corpora, on PySpark.

Functions that end up inside Arrow UDFs are pickled by value, so executors do
not need this package on their own Python path.
"""

import importlib
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"

#: The public interface; modules are imported when a name is first used.
_API = {
    "BenchmarkSpec": "config", "ItemStopGrams": "config", "Normalization": "config", "ScanConfig": "config", "Index": "operators.index", "build_index": "operators.index",
    "load_benchmark": "operators.index", "scan": "plans.scan", "records": "plans.scan", "shard_summary": "plans.scan", "run_summary": "plans.scan", "execute": "plans.run",
    "write_filtered": "plans.filtering", "write_report": "plans.report", "Detector": "operators.detector",
}
__all__ = sorted(_API)  # noqa: PLE0605


def __getattr__(name: str):
    if name not in _API:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"siftgram.{_API[name]}"), name)
