"""Column functions: names, numbers, dates, scores and text."""
