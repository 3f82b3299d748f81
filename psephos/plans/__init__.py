"""The shipped analysis: candidates for two offices, from extracts to reports."""
