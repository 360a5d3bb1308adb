"""A Spark-first engine for speech-audio tables and training-data pipelines."""
