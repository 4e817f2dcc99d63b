"""fedlens: a Spark-native engine that analyses federated-learning runs as data."""

__version__ = "0.1.0"
