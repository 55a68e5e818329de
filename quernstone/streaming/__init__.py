"""Quernstone: streaming."""
