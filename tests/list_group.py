"""Command line: names of the queries of some catalogue modules."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

print(*[k for k, f in entry.queries().items() if f.__module__.split(".")[-1] in sys.argv[1:]])
