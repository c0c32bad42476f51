"""spanloom: structured extraction, evaluation and schema evolution over text spans, on Spark DataFrames."""
