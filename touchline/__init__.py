"""Football match analytics as PySpark DataFrame operators."""
