"""Reading, pruning, inspecting and writing ORC with PySpark."""
