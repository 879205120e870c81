"""PySpark-native analytics for auditing the privacy and fidelity of synthetic count data."""
