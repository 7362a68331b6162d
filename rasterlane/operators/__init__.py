"""Operators over cells, blocks, objects and captures."""
