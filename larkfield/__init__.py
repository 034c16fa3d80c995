"""Local-business entity resolution, website evidence and lead research on Spark."""
