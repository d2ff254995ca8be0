"""mildtext: curation, rewriting and evaluation of text-detoxification pairs as Spark jobs.

Every operator takes DataFrames and returns a DataFrame.  Subpackages:

* ``functions``  column expressions (text cleaning, scores)
* ``sources``    readers and writers (pairs, inputs, lexicons, results)
* ``operators``  dedup, split, sample, rewrite, score, evaluate, report
* ``plans``      whole jobs composed from the operators
"""

from mildtext.config import EvalConfig, PrepConfig

__all__ = ["EvalConfig", "PrepConfig"]
