"""Composite jobs: zero-filling, basal area, zones, the two campaigns, analysis bases and the fit list."""
