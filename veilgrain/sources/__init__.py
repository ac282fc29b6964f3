"""Reading, flattening, decoding and freezing of input tables."""
