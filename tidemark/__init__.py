"""Leakage-safe temporal panel analytics as composable PySpark DataFrame operators."""
