"""Queries over the driver's tables: bindings, registry and reference SQL."""
