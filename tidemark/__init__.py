"""Resource history analytics on Spark: change capture, history queries, recovery and replay."""
