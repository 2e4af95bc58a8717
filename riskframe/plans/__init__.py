"""Complete queries over the shared fixture, each with its SQL twin."""
