"""A Spark-first engine for retrieval, multi-hop question answering and corpus preparation."""
