"""tidewell: a PySpark-native engine for Chamfer-distance workloads over large, changing vector sets."""
