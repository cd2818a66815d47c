"""Static tables, parameters, founders and views of the driver tables."""
