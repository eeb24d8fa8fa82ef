"""Whole jobs: from files to maps, and where intermediate tables go."""
