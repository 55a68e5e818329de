"""Quernstone: plans."""
