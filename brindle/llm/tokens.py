"""The encoder of functions/encoder.py under the name that the operators of this folder use."""

from brindle.functions.encoder import _LOADED, CACHE_BYTES, CACHE_CHUNK, Encoder, encoder, forget, give_back, without_gc

__all__ = ["_LOADED", "CACHE_BYTES", "CACHE_CHUNK", "Encoder", "encoder", "forget", "give_back", "without_gc"]
