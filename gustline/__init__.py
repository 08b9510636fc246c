"""gustline: walk-forward multi-factor analytics on Spark DataFrames."""
