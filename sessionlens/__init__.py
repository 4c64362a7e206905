"""Analytics of coding-agent session logs on Spark."""
