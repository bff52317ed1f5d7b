"""Detectors, filters and joins. A detector is a function that returns a Column of
findings over a prepared frame (see ``riskloom.plans.scan.prepare``)."""
