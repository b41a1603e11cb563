"""Operators of a training-data pipeline. Nothing else in riskbook imports this subpackage."""
