"""Training-data operators: cleaning, deduplication, tokenising, formatting, vector search.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""

import os

# A Python worker has one task: matrix products take one thread, as Spark itself sets it on
# executors with a known number of cores, though not in local mode.
os.environ.setdefault("OMP_NUM_THREADS", "1")
