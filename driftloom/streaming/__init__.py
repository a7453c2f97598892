"""Session state over streams of observations."""
