"""Where logs and loops come from and go to."""
