"""File triage, stream cleaning and training-table analytics on Spark."""
