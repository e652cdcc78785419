"""sparkloom: Spark-native analytics over collections of source files and documents."""

__version__ = "0.1.0"
