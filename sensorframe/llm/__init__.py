"""Operators for training data: pairing by nearest time, tokenizing, packing and truncation."""
