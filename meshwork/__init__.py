"""meshwork: a PySpark-native engine for searching team communication and finding overlapping work."""
