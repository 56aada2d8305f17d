"""A PySpark-native analytics engine over transfer streams."""
