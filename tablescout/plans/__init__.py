"""Jobs that chain operators: profiling, lake builds, searches, and the query registry."""
