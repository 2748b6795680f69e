"""Reading and writing the tables of an experiment."""
