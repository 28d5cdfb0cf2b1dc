"""Page-level text retrieval, search analytics and data preparation as Spark plans."""
