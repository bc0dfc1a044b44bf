"""splitscope: controlled-experiment (A/B/n) analytics on Spark DataFrames.

Layers:
  sources/    readers, the session projection of the test tables, writers
  functions/  column-expression helpers, the country->region mapping, p-value tails
  operators/  profiling, quality checks, cleaning, EDA, user metrics, breakdowns,
              significance tests, decision rules, report projections
  plans/      end-to-end compositions and the query catalogue
  streaming/  micro-batch ingestion of session files into the batch operators
"""

from splitscope.spec import ExperimentSpec, Thresholds, NOTEBOOK_SPEC, TEMPLATE_SPEC

__all__ = ["ExperimentSpec", "Thresholds", "NOTEBOOK_SPEC", "TEMPLATE_SPEC"]
