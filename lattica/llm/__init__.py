"""Training-data operators: quality, language, near-duplicates, mixing and the like."""

import os

# Small matrices gain nothing from more threads, and tasks run side by side; takes effect where numpy isn't loaded yet.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")
