"""Column functions: text normalisation, identifiers, dates, and similarity."""
