"""Sample conditioning, the sliding search, and online coincidence."""
