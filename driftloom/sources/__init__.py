"""Where data comes from and goes to: request bodies, event streams, stored references, settings."""
