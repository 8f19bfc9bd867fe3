"""martelo: judicial-auction analytics as Spark DataFrame operators."""
