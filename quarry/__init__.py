"""Spark-native retrieval, ledger and document operators: pure DataFrame-to-DataFrame functions."""
