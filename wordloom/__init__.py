"""Text curation and learning-state analytics as plain DataFrame operators."""
