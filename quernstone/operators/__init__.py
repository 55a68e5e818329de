"""Quernstone: operators."""
