"""Operators for building training corpora: filtering, de-duplication, packing, archives."""
