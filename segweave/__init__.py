"""segweave: Spark-first analytics over ordered, typed blocks of model context."""
