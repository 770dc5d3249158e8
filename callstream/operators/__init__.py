"""DataFrame-to-DataFrame operators; unless noted, for batch and streaming input."""
