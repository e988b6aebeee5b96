"""Operators over any DataFrame: columns, filters, joins, aggregates and quantiles."""
