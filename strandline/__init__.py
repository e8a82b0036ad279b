"""Timeline analytics over corpora of annotated media, as Spark DataFrame operators keyed by video."""
