"""kinoframe: frame, block and trace analytics as Spark jobs."""
