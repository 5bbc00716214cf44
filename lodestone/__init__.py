"""lodestone: vector, keyword and hybrid search, aggregation and collection jobs as Spark plans."""
