"""Reading and writing data, row keys, shared scratch space and the run history."""
