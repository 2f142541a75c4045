"""Context-cost analytics over agent transcripts, and corpus preparation, as Spark jobs."""
