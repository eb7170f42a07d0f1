"""Column functions: lines of contents, canonical framing, digests, paths."""
