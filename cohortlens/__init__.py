"""cohortlens: binary-outcome analytics over wide profile tables, on Spark.

Sub-packages:
  sources    - table readers/writers, the wide profile views, model persistence
  functions  - column-expression helpers (bins, rounding, hashing, formatting)
  operators  - DataFrame -> DataFrame operators (quality, rates, statistics,
               splits, features, models, evaluation, decision support)
  plans      - bindings of operators to the test tables and their SQL oracles
  streaming  - Structured Streaming scoring
"""

from cohortlens.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
