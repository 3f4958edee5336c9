"""lyrebird: catalogue, collection and training-corpus analytics as Spark jobs."""
