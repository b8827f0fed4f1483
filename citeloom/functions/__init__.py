"""Column-level functions and order-aware helpers."""
