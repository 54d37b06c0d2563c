"""Jobs over the given tables, run from the command line or from another program."""
