"""Where the streams come from."""
