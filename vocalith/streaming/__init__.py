"""Event-time twins of the frame operators; the same functions serve batch and streaming tables."""
