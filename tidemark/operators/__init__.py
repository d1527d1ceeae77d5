"""Operators over readings, fly-days and features."""
