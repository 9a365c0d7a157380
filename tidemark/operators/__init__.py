"""Dataset operators: collapse, classify, recover, replay, watch plan, metrics."""
