"""Reusable operators the reports are composed of."""
