"""Session fixtures come from the folder above."""
