"""DataFrame-to-DataFrame operators on the weekly panel."""
