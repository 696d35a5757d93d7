"""Operators for preparing training text: see README, "Training-data operators"."""
