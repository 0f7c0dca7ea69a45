"""Reading log files, parsing lines, and the stored event table."""
