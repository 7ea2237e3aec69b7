"""A PySpark-native engine for molecular formulas of tandem mass spectra."""
