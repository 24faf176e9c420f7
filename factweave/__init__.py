"""factweave: a Spark-native analytics engine for tables of facts about programs."""

__version__ = "0.1.0"
