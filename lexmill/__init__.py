"""Legal-document and contract analytics as PySpark DataFrame operators."""
