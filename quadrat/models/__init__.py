"""Count-rate models, their evaluation, associations, path analysis and figure tables."""
