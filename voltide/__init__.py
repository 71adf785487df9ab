"""Analytics over option chains and volatility surfaces as Spark DataFrame operators."""
