"""Review of source-code corpora as Spark jobs.

Every public function takes and returns DataFrames or Columns; no session is
created inside the package.
"""
