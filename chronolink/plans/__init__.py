"""Plans that compose operators: method router, pipeline, command line."""
