"""Catalog search and recommendation as Spark DataFrame operators.

functions/   Column -> Column: URLs, HTML fields, text classifiers, vectors
operators/   DataFrame -> DataFrame: links, page fields, dedup, top-k, rerank
sources/     readers and writers for every table the engine exchanges
plans/       whole jobs: build a catalog, index it, search, recommend, evaluate
streaming/   queries arriving as a stream against a static catalog
"""

import sys

from pyspark import cloudpickle

from pickwell.session import get_session

# Code that runs inside tasks travels with them, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
