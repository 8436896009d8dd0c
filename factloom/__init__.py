"""factloom: Spark-first document-evidence analytics."""
