"""Files and folders."""
