"""Row-level and set-level corpus operators as DataFrame transformations."""
