"""Customer analytics on Spark: features, churn, risk, segments and campaign lists."""
