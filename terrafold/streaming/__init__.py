"""Mergeable edits in batch and as keyed streaming state."""
