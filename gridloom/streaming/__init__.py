"""Forward-only decoding of byte streams in bounded memory."""
