"""Training-data operators. Outside of this subpackage only near duplicates use its tables, components and columns."""
