"""Factor research, volatility targeting and corpus preparation as Spark DataFrame programs."""
