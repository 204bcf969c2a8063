"""Document-conversion analytics and corpus preparation as Spark DataFrame operators."""
