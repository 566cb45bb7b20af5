"""Marlstone: a PySpark-native engine for benchmark manifests and detector scores."""
