"""tidelog: container-log analytics as PySpark DataFrame operators and streams."""
