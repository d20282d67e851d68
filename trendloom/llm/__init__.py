"""Operators that turn raw text collections into training data."""
