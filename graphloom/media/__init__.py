"""Layouts and decoding of textures, sprites and audio."""
