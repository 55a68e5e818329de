"""Quernstone: functions."""
