"""The change log in batch and as a stream, and derived views that follow it."""
