"""Batch and streaming jobs over large stores of agent conversations."""
