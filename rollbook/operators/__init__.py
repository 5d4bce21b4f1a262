"""Operators over registry records: filters, resolution, aggregation, search, entities, learning."""
