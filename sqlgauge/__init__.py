"""Text-to-SQL evaluation as Spark jobs: every public function takes and returns DataFrames or Columns."""
