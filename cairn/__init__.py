"""cairn: snapshot-store analytics as PySpark DataFrame operators."""
