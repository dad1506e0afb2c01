"""tabsight: automatic tabular analysis expressed as Spark DataFrame plans.

Sub-packages:
  sources    - table scans (Parquet, CSV with type narrowing) and sinks (models, labelled tables)
  functions  - column-expression builders (name rules, bands, safe arithmetic)
  operators  - profile, screening, preprocessing, clustering, model evaluation, findings
  plans      - end-to-end analysis runs and the query catalogue used by the driver
  streaming  - applying fitted pipelines to streaming DataFrames
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
