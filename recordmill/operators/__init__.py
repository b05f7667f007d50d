"""Record-set operators as DataFrame transformations."""
