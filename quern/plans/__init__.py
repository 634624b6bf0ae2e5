"""From SQL text with an error clause to estimator calls."""
