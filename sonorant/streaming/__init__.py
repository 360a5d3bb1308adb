"""The stateful streaming chain."""
