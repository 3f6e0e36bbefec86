"""Operators for large-scale training-data pipelines; nothing else in lodestrand imports this subpackage."""
