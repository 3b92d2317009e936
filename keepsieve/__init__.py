"""keepsieve: a PySpark-native engine for archives of saved web items."""

__version__ = "0.1.0"
