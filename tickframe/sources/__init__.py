"""Reading and writing tables of match logs."""
