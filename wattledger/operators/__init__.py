"""DataFrame operators: normalisation, axes, series, cost, budget, alerts and forecasts."""
