"""Column functions: costs, subjects, numbers and dates."""
