"""Operators that prepare training data: rules, tokens, extraction, packing, de-duplication, models."""
