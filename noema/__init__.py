"""noema: a PySpark-native engine for provenance-aware knowledge graphs."""
