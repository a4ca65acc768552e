"""brindle: corpus curation and model-evaluation analytics as PySpark DataFrame operators."""
