"""A PySpark-native engine for building, gating and analysing question-answering corpora."""
