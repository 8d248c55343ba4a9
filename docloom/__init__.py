"""docloom: a Spark-first engine for analysing business documents."""
