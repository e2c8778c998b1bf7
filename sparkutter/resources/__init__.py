"""Fixed resources."""
