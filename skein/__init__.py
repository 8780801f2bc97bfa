"""skein: PySpark-native analytics over time-coded, multi-source archives."""
