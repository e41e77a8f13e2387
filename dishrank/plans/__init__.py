"""User-level jobs: batch build, ranked lookups, term harvest."""
