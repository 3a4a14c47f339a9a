"""skein: Spark jobs for catalog ingestion, search, evaluation and text corpora."""
