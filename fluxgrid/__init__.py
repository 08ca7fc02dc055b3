"""fluxgrid package."""
