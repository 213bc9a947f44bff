"""Operators of a training-data pipeline. Nothing outside this folder imports them, except the guarded entry point."""
