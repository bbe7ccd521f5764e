"""Corpus operators for evidence intake texts: scans, duplicates, rules, models, mixing.

Every operator takes DataFrames of intake records (evidence_id, intake_notes,
source_platform, ...) and returns DataFrames. Nothing outside this folder and
corpus_pipeline.py imports it.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
