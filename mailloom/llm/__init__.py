"""Operators for training data made of e-mail texts. Nothing outside this package imports it."""
