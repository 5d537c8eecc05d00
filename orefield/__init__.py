"""orefield: a PySpark-native data-mining and corpus-processing engine."""
