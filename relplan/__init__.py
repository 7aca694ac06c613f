"""relplan: a relational dataflow engine expressed on the Spark DataFrame API."""
