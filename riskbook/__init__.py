"""riskbook."""
