"""Operators for preparing training data: ten pieces, each usable on its own.

Nothing outside this folder imports it; the engine works without it.
"""
