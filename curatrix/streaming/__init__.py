"""File-stream forms of the incremental jobs."""
