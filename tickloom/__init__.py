"""tickloom: bar analytics and trading signals as Spark DataFrame jobs."""
