"""tessera: a document analytics engine expressed in Spark's own plans."""
