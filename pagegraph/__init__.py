"""pagegraph: Spark-first analytics over page collections, link graphs and document corpora."""
