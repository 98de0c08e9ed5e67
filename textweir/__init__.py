"""textweir: Spark-first operators for curating large text corpora."""
