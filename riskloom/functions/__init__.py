"""Column functions shared by the detectors."""
