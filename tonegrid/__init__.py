"""tonegrid: a PySpark-native engine for event streams of symbolic music and their token sequences."""
