"""Part of the drawlake package."""
