"""Operators on streams: stateless ones as they are, windows by watermark, rolling ones with state."""
