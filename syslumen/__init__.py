"""syslumen: a PySpark-native analytics engine for network-device logs."""

__version__ = "0.1.0"
