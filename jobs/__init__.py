"""Jobs that a scheduler runs: each has a command line and a small config file."""
