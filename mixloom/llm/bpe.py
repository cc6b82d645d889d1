"""The exact byte-level encoder, which the core has too."""

from mixloom.functions.bpe import CHUNKS, PATTERN, SPACES, Encoder, _clean, encoder, vocabulary_path

__all__ = ["CHUNKS", "PATTERN", "SPACES", "Encoder", "clean", "encoder", "vocabulary_path"]
clean = _clean
