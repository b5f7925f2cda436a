"""cohort_signal: cohort outcome prediction and early warning on Spark.

Subpackages:
    sources    -- readers, writers and the cohort-shaped inputs derived from tables
    functions  -- Column builders (cleaning, row-wise statistics, labels, tails)
    operators  -- DataFrame operators (joins, profiles, tests, models, risk)
    plans      -- end-to-end pipelines and the query catalogue
    streaming  -- incremental scoring of arriving cohort rows
"""

__version__ = "0.1.0"
