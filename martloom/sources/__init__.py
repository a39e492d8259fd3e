"""Reading, writing and laying out tables."""
