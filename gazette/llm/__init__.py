"""Operators for training-data pipelines: tokens, language, secrets, near copies, benchmark leaks, personal data and scores."""
