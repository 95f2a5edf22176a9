"""graftline: interaction-tree analytics and training-data preparation on PySpark."""
