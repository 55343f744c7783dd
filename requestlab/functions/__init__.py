"""Column functions: text in, text or flags out, no shuffle and no Python on the executors."""
