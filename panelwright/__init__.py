"""A PySpark-native engine for session-aligned panels, event features and text corpora."""
